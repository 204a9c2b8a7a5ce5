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
)
SELECT d.event_id, d.user_id, d.ts,
       CASE WHEN d.ts <= s.ts + INTERVAL 6 HOUR THEN s.event_id END AS search_event_id,
       CASE WHEN d.ts <= s.ts + INTERVAL 6 HOUR THEN s.ts END AS search_ts
FROM log d ASOF LEFT JOIN (SELECT * FROM log WHERE kind = 'search') s
  ON d.user_id = s.user_id AND d.ts > s.ts
WHERE d.kind = 'detail'
