SELECT CAST(ts AS DATE) AS day, count(*) AS searches,
       count(*) FILTER (WHERE event_type = 'error') AS no_result,
       count(*) FILTER (WHERE event_type = 'error') / count(*) AS rate
FROM events
WHERE event_type IN ('view', 'error')
GROUP BY day
