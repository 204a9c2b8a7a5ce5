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
), each AS (
  SELECT user_id, count(*) FILTER (WHERE result_count > 0) AS n_a,
         count(*) FILTER (WHERE result_count > 0 AND entered) AS hits_a,
         count(*) FILTER (WHERE result_count = 0) AS n_b,
         count(*) FILTER (WHERE result_count = 0 AND entered) AS hits_b
  FROM entries WHERE user_id IS NOT NULL GROUP BY user_id
), uniform AS (
  SELECT each.*, r,
         CAST('0x' || substr(md5('1:' || user_id || ':' || (r // 4)), 1 + 8 * (r % 4), 8) AS BIGINT) AS u
  FROM each, generate_series(0, 199) AS g(r)
), weighted AS (
  SELECT *, len(list_filter([1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817, 4294967252, 4294967292], lambda x: u >= x)) AS w
  FROM uniform
), replicate AS (
  SELECT sum(w * hits_a) / sum(w * n_a) - sum(w * hits_b) / sum(w * n_b) AS d
  FROM weighted GROUP BY r HAVING sum(w * n_a) > 0 AND sum(w * n_b) > 0
)
SELECT (SELECT count(*) FROM each) AS clusters,
       (SELECT round(sum(hits_a) / sum(n_a) - sum(hits_b) / sum(n_b), 6) FROM each) AS difference,
       round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high,
       round(least(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1), 6) AS p_value,
       count(*) AS replicates
FROM replicate
