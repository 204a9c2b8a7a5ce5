WITH log AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_type IN ('view', 'error') THEN 'search'
              WHEN event_type = 'click' THEN 'detail' ELSE 'other' END AS kind,
         CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 0 END AS result_count,
         CASE WHEN event_type = 'error' THEN 'no_result' WHEN event_type = 'view' THEN 'search'
              WHEN event_type = 'click' THEN 'detail' ELSE 'other' END AS step,
         CAST(CAST(json_extract_string(props, '$.k') AS INT) // 10 AS VARCHAR) AS area,
         CAST(CAST(json_extract_string(props, '$.k') AS INT) % 10 AS VARCHAR) AS price
  FROM events
), ranked AS (
  SELECT user_id, step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
  FROM log
)
SELECT a.step, b.step AS next_step, count(*) AS pairs
FROM ranked a JOIN ranked b ON a.user_id = b.user_id AND b.place = a.place + 1
GROUP BY a.step, b.step
