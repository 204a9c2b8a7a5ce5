WITH per_user AS (SELECT user_id, count(*) AS events FROM events GROUP BY user_id),
ordered AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT sha256(concat('example salt:', c_custkey)) AS user_id,
       sha256(concat('example salt:', c_name)) AS c_name,
       c_nationkey, c_acctbal, c_mktsegment, events, orders
FROM customer LEFT JOIN per_user ON user_id = c_custkey LEFT JOIN ordered ON o_custkey = c_custkey
