WITH kept_customers AS (
  SELECT c_custkey FROM customer
  WHERE CAST(concat('0x', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15)) AS BIGINT) < 230584300921369408
)
SELECT lineitem.*
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM kept_customers)
