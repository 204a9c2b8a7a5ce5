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
), marked AS (
  SELECT *, coalesce(ts > lag(ts) OVER u + INTERVAL 6 HOUR, true) AS starts
  FROM log WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM marked
)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events,
       count(*) FILTER (WHERE kind = 'search') AS searches,
       count(*) FILTER (WHERE step = 'no_result') AS no_results,
       count(*) FILTER (WHERE kind = 'detail') AS details
FROM numbered
GROUP BY user_id, session
