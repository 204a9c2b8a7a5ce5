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
), searches AS (
  SELECT s.*, p.event_id AS prev_event_id, p.result_count AS prev_count,
         p.area AS prev_area, p.price AS prev_price,
         coalesce(s.ts <= p.ts + INTERVAL 6 HOUR, false) AS is_re_search
  FROM log s ASOF LEFT JOIN (SELECT * FROM log WHERE kind = 'search') p
    ON s.user_id = p.user_id AND s.ts > p.ts
  WHERE s.kind = 'search'
)
SELECT event_id, user_id, ts, prev_event_id,
       concat_ws(',', CASE WHEN area IS DISTINCT FROM prev_area THEN 'area' END,
                 CASE WHEN price IS DISTINCT FROM prev_price THEN 'price' END) AS changed
FROM searches
WHERE is_re_search
