SELECT *, concat_ws(',', CASE WHEN o_custkey IS NULL THEN 'o_custkey not null' END,
  CASE WHEN o_totalprice NOT BETWEEN 1000 AND 400000 THEN 'o_totalprice in range' END,
  CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') THEN 'o_orderpriority format' END) AS failed_rules
FROM orders
WHERE NOT (o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 400000
  AND regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$'))
