WITH old AS (
  SELECT * FROM orders WHERE o_totalprice >= 2000
), new AS (
  SELECT * REPLACE (CASE WHEN o_totalprice > 495000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus)
  FROM orders WHERE o_totalprice <= 498000
)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS state,
       CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE 'o_orderstatus' END AS changed
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus
