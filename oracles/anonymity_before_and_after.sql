WITH RECURSIVE known AS (
  SELECT row_number() OVER () AS id, c_nationkey, o_totalprice,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS order_day, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey
), ends AS (
  SELECT CAST(min(c_nationkey) AS DOUBLE) AS a0, CAST(max(c_nationkey) AS DOUBLE) AS b0,
         min(o_totalprice) AS a1, max(o_totalprice) AS b1,
         CAST(min(order_day) AS DOUBLE) AS a2, CAST(max(order_day) AS DOUBLE) AS b2
  FROM known
), codes AS (
  SELECT id, unnest([0, 1, 2]) AS dim, unnest([
    CAST(least(floor((c_nationkey - a0) * 1024 / (b0 - a0)), 1023) AS INTEGER),
    CAST(least(floor((o_totalprice - a1) * 1024 / (b1 - a1)), 1023) AS INTEGER),
    CAST(least(floor((order_day - a2) * 1024 / (b2 - a2)), 1023) AS INTEGER)]) AS code
  FROM known, ends
), cutting AS (
  -- Each row of a class that was cut in the step before, then of the two that came of it.
  SELECT id, CAST(1 AS BIGINT) AS class, true AS open FROM known
  UNION ALL
  SELECT id, class, open FROM (
    WITH placed AS (SELECT p.id, p.class, dim, code FROM cutting p JOIN codes USING (id) WHERE p.open),
    medians AS (
      SELECT class, dim, quantile_disc(code, 0.5) AS cut, max(code) - min(code) AS span
      FROM placed GROUP BY class, dim
    ), allowed AS (
      SELECT class, dim, any_value(cut) AS cut, any_value(span) AS span
      FROM placed JOIN medians USING (class, dim) GROUP BY class, dim
      HAVING count(*) FILTER (code <= cut) >= 20 AND count(*) FILTER (code > cut) >= 20
    ), best AS (
      SELECT class, arg_max(dim, span * 10 - dim) AS dim, arg_max(cut, span * 10 - dim) AS cut
      FROM allowed GROUP BY class
    )
    SELECT id, 2 * class + CASE WHEN code > cut THEN 1 ELSE 0 END AS class, true AS open
    FROM placed JOIN best USING (class, dim)
  )
), final AS (SELECT id, max(class) AS class FROM cutting GROUP BY id
), classes AS (
  SELECT class, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT o_orderpriority) AS "values",
         min(c_nationkey) AS c_nationkey_from, max(c_nationkey) AS c_nationkey_to,
         min(o_totalprice) AS o_totalprice_from, max(o_totalprice) AS o_totalprice_to,
         CAST(min(order_day) AS INTEGER) AS order_day_from, CAST(max(order_day) AS INTEGER) AS order_day_to
  FROM known JOIN final USING (id) GROUP BY class
), plain AS (
  SELECT count(*) AS rows, count(DISTINCT o_orderpriority) AS "values" FROM known
  GROUP BY c_nationkey, o_totalprice, order_day
)
SELECT 'before' AS stage, count(*) AS classes, CAST(sum(rows) AS BIGINT) AS rows, min(rows) AS k, min("values") AS l
FROM plain
UNION ALL
SELECT 'after' AS stage, count(*) AS classes, CAST(sum(rows) AS BIGINT) AS rows, min(rows) AS k, min("values") AS l
FROM classes
