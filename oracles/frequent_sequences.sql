WITH step AS (
  SELECT user_id, ts, event_id,
         CASE event_type WHEN 'error' THEN 'no_result' ELSE 'search' END || ' '
           || (CAST(json_extract_string(props, '$.k') AS INT) // 10) AS item
  FROM events WHERE event_type IN ('view', 'error') AND user_id IS NOT NULL
), found AS (
  SELECT DISTINCT item AS pattern, 1 AS length, user_id FROM step
  UNION ALL
  SELECT DISTINCT a.item || ' > ' || b.item, 2, user_id
  FROM step a JOIN step b USING (user_id) WHERE (a.ts, a.event_id) < (b.ts, b.event_id)
  UNION ALL
  SELECT DISTINCT a.item || ' > ' || b.item || ' > ' || c.item, 3, user_id
  FROM step a JOIN step b USING (user_id) JOIN step c USING (user_id)
  WHERE (a.ts, a.event_id) < (b.ts, b.event_id) AND (b.ts, b.event_id) < (c.ts, c.event_id)
)
SELECT pattern, length, count(*) AS support
FROM found GROUP BY pattern, length
HAVING count(*) >= ceil(0.4 * (SELECT count(DISTINCT user_id) FROM step))
