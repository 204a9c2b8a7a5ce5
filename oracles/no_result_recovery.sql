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
), followed AS (
  SELECT s.event_id, n.step
  FROM log s ASOF LEFT JOIN (SELECT * FROM log WHERE kind <> 'other') n
    ON s.user_id = n.user_id AND s.ts < n.ts
  WHERE s.step = 'no_result' AND n.ts <= s.ts + INTERVAL 6 HOUR
)
SELECT CASE coalesce(f.step, '-') WHEN '-' THEN 'abandoned' WHEN 'search' THEN 'results'
       ELSE f.step END AS outcome, count(*) AS searches
FROM log s LEFT JOIN followed f USING (event_id)
WHERE s.step = 'no_result'
GROUP BY 1
