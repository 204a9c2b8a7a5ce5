WITH daily AS (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS value
  FROM events
  WHERE event_type IN ('view', 'error')
  GROUP BY day
)
SELECT a.day, a.value, CAST(sum(b.value) AS BIGINT) AS rolling
FROM daily a JOIN daily b ON b.day BETWEEN a.day - 6 AND a.day
GROUP BY a.day, a.value
