SELECT 'o_custkey not null' AS rule, count(*) AS checked, count(*) FILTER (WHERE o_custkey IS NULL) AS failed
FROM orders
UNION ALL
SELECT 'o_totalprice in range' AS rule, count(o_totalprice) AS checked, count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000) AS failed
FROM orders
UNION ALL
SELECT 'o_orderpriority format' AS rule, count(o_orderpriority) AS checked, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')) AS failed
FROM orders
