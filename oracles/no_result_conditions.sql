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
), fields AS (
  SELECT 'area' AS field, area AS value, step FROM log WHERE kind = 'search'
  UNION ALL
  SELECT 'price', price, step FROM log WHERE kind = 'search'
)
SELECT field, value, count(*) AS searches, count(*) FILTER (WHERE step = 'no_result') AS no_result,
       count(*) FILTER (WHERE step = 'no_result') / count(*) AS rate
FROM fields
GROUP BY field, value
ORDER BY no_result DESC, field, value
LIMIT 10
