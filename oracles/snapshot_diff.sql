WITH old AS (
  SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'
), new AS (
  SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus)
  FROM orders WHERE o_orderstatus <> 'F'
)
SELECT o_orderkey,
       CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed'
            WHEN o.o_orderstatus <> n.o_orderstatus THEN 'changed' ELSE 'same' END AS state,
       CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed
FROM old o FULL JOIN new n USING (o_orderkey)
