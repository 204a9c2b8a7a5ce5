WITH people AS (
  SELECT c_custkey FROM customer
  ORDER BY CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15) AS BIGINT), c_custkey LIMIT 1000
)
SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM people)
