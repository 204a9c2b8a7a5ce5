WITH nations AS (
  SELECT * FROM nation
  WHERE CAST(concat('0x', substr(md5(CAST(n_nationkey AS VARCHAR)), 1, 15)) AS BIGINT) < 345876451382054080
), customers AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nations)
), suppliers AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nations)
), kept_orders AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customers)
), kept_events AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM customers)
), lines AS (
  SELECT * FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM kept_orders)
    AND l_suppkey IN (SELECT s_suppkey FROM suppliers)
)
SELECT 'nation' AS child, 'n_regionkey' AS columns, 'region' AS parent, count(*) AS broken
FROM nations WHERE n_regionkey IS NOT NULL AND NOT EXISTS (FROM region WHERE r_regionkey = n_regionkey)
UNION ALL
SELECT 'customer' AS child, 'c_nationkey' AS columns, 'nation' AS parent, count(*) AS broken
FROM customers WHERE c_nationkey IS NOT NULL AND NOT EXISTS (FROM nations WHERE n_nationkey = c_nationkey)
UNION ALL
SELECT 'supplier' AS child, 's_nationkey' AS columns, 'nation' AS parent, count(*) AS broken
FROM suppliers WHERE s_nationkey IS NOT NULL AND NOT EXISTS (FROM nations WHERE n_nationkey = s_nationkey)
UNION ALL
SELECT 'orders' AS child, 'o_custkey' AS columns, 'customer' AS parent, count(*) AS broken
FROM kept_orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (FROM customers WHERE c_custkey = o_custkey)
UNION ALL
SELECT 'events' AS child, 'user_id' AS columns, 'customer' AS parent, count(*) AS broken
FROM kept_events WHERE user_id IS NOT NULL AND NOT EXISTS (FROM customers WHERE c_custkey = user_id)
UNION ALL
SELECT 'lineitem' AS child, 'l_orderkey' AS columns, 'orders' AS parent, count(*) AS broken
FROM lines WHERE l_orderkey IS NOT NULL AND NOT EXISTS (FROM kept_orders WHERE o_orderkey = l_orderkey)
UNION ALL
SELECT 'lineitem' AS child, 'l_partkey' AS columns, 'part' AS parent, count(*) AS broken
FROM lines WHERE l_partkey IS NOT NULL AND NOT EXISTS (FROM part WHERE p_partkey = l_partkey)
UNION ALL
SELECT 'lineitem' AS child, 'l_suppkey' AS columns, 'supplier' AS parent, count(*) AS broken
FROM lines WHERE l_suppkey IS NOT NULL AND NOT EXISTS (FROM suppliers WHERE s_suppkey = l_suppkey)
