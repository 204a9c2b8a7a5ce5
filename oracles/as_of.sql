WITH version AS (
  SELECT 1 AS n, orders.* FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL
  SELECT 2, o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END,
         o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL
  SELECT 3, orders.* FROM orders
), history AS (
  SELECT a.* EXCLUDE (n), 'v' || a.n AS valid_from,
         'v' || (SELECT min(m) FROM range(a.n + 1, 4) AS r(m)
                 WHERE NOT EXISTS (SELECT 1 FROM version b WHERE b.n = m AND b.o_orderkey = a.o_orderkey
                                    AND b.o_orderstatus = a.o_orderstatus)) AS valid_to
  FROM version a
  WHERE NOT EXISTS (SELECT 1 FROM version b WHERE b.n = a.n - 1 AND b.o_orderkey = a.o_orderkey
                     AND b.o_orderstatus = a.o_orderstatus)
)
SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, 'v2' AS asked, o_orderstatus, valid_from, valid_to
FROM lineitem LEFT JOIN history
  ON o_orderkey = l_orderkey AND valid_from <= 'v2' AND (valid_to IS NULL OR valid_to > 'v2')
