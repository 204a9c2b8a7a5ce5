SELECT 'orders' AS "table", 'o_custkey not null' AS rule, count(*) AS checked, count(*) FILTER (WHERE o_custkey IS NULL) AS failed
FROM orders
UNION ALL
SELECT 'orders' AS "table", 'o_totalprice in range' AS rule, count(o_totalprice) AS checked, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS failed
FROM orders
UNION ALL
SELECT 'orders' AS "table", 'o_orderpriority format' AS rule, count(o_orderpriority) AS checked, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')) AS failed
FROM orders
UNION ALL
SELECT 'lineitem' AS "table", 'l_discount in range' AS rule, count(l_discount) AS checked, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) AS failed
FROM lineitem
UNION ALL
SELECT 'lineitem' AS "table", 'l_quantity in range' AS rule, count(l_quantity) AS checked, count(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 45) AS failed
FROM lineitem
UNION ALL
SELECT 'customer' AS "table", 'c_name format' AS rule, count(c_name) AS checked, count(*) FILTER (WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')) AS failed
FROM customer
UNION ALL
SELECT 'orders', 'order key', count(*), count(*) FILTER (WHERE copies > 1)
FROM (SELECT count(*) OVER (PARTITION BY o_orderkey) AS copies FROM orders)
UNION ALL
SELECT 'lineitem', 'line key', count(*), count(*) FILTER (WHERE copies > 1)
FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem)
UNION ALL
SELECT 'lineitem', 'order of line', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
FROM lineitem
UNION ALL
SELECT 'documents', 'label of document', count(*), count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels))
FROM documents
UNION ALL
SELECT 'lineitem', 'shipped after order', count(*), count(*) FILTER (WHERE l_shipdate < o_orderdate)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
