WITH old AS (
  SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'
), new AS (
  SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus)
  FROM orders WHERE o_orderstatus <> 'F'
)
SELECT *, '2025-05-02_v2' AS snapshot
FROM new
