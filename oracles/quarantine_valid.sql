SELECT *
FROM orders
WHERE o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 400000
  AND regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$')
