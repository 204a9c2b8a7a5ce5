WITH status AS (
  SELECT v, row_number() OVER (ORDER BY md5(v), v) AS id
  FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL)
), priority AS (
  SELECT v, row_number() OVER (ORDER BY md5(v), v) AS id
  FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority IS NOT NULL)
)
SELECT orders.* REPLACE (s.id AS o_orderstatus, p.id AS o_orderpriority)
FROM orders LEFT JOIN status s ON o_orderstatus = s.v LEFT JOIN priority p ON o_orderpriority = p.v
