WITH active AS (
  SELECT DISTINCT CASE WHEN event_type IN ('view', 'error') THEN 'search'
                       WHEN event_type = 'click' THEN 'detail' ELSE 'other' END AS kind,
         CAST(ts AS DATE) AS day, user_id
  FROM events WHERE user_id IS NOT NULL
), days AS (SELECT DISTINCT kind, day FROM active)
SELECT d.kind, d.day, count(DISTINCT a.user_id) AS users
FROM days d JOIN active a ON a.kind = d.kind AND a.day BETWEEN d.day - 6 AND d.day
GROUP BY d.kind, d.day
