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
), next_detail AS (
  SELECT s.event_id, min(d.event_id) AS detail_event_id, min(d.ts) AS detail_ts
  FROM log s JOIN log d ON d.user_id = s.user_id AND d.kind = 'detail'
   AND (d.ts, d.event_id) > (s.ts, s.event_id) AND d.ts <= s.ts + INTERVAL 6 HOUR
  WHERE s.kind = 'search'
    AND NOT EXISTS (
      SELECT 1 FROM log b
      WHERE b.user_id = s.user_id AND b.kind = 'search'
        AND (b.ts, b.event_id) > (s.ts, s.event_id) AND (b.ts, b.event_id) < (d.ts, d.event_id))
  GROUP BY s.event_id
), entries AS (
  SELECT s.event_id, s.user_id, s.ts, s.result_count,
         d.event_id IS NOT NULL AS entered, d.detail_event_id, d.detail_ts
  FROM log s LEFT JOIN next_detail d USING (event_id)
  WHERE s.kind = 'search'
)
SELECT result_count, count(*) AS searches, count(*) FILTER (WHERE entered) AS entered
FROM entries
GROUP BY result_count
