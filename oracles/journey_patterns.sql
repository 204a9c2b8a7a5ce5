WITH RECURSIVE numbered AS (
  SELECT event_id, ts, user_id,
         CASE event_type WHEN 'error' THEN 'no_result' WHEN 'view' THEN 'search'
              WHEN 'click' THEN 'detail' ELSE 'other' END AS step,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place
  FROM events WHERE user_id IS NOT NULL
), pattern(pattern, j, step, repeated, is_last) AS (
  VALUES ('found after none', 1, 'search', false, false), ('found after none', 2, 'no_result', true, false),
         ('found after none', 3, 'search', false, false), ('found after none', 4, 'detail', false, true),
         ('gave up', 1, 'no_result', false, false), ('gave up', 2, 'no_result', true, false),
         ('gave up', 3, 'other', false, true),
         ('looked on', 1, 'no_result', true, false), ('looked on', 2, 'search', false, true),
         ('details only', 1, 'detail', false, false), ('details only', 2, 'detail', true, true)
), walk AS (
  SELECT pattern, j, is_last, user_id, place, event_id, ts, ts AS started
  FROM numbered JOIN pattern USING (step) WHERE j = 1
  UNION
  SELECT w.pattern, p.j, p.is_last, n.user_id, n.place, n.event_id, n.ts, w.started
  FROM walk w
  JOIN numbered n ON n.user_id = w.user_id AND n.place = w.place + 1
  JOIN pattern p ON p.pattern = w.pattern AND p.step = n.step
   AND (p.j = w.j + 1 OR (p.j = w.j AND p.repeated))
), matches AS (
  SELECT pattern, user_id, event_id, max(started) AS started, ts AS ended
  FROM walk WHERE is_last AND ts <= started + INTERVAL 2 DAY
  GROUP BY pattern, user_id, event_id, ts
)
SELECT pattern, count(*) AS matches, count(DISTINCT user_id) AS users, min(ended) AS first_match
FROM matches GROUP BY pattern
