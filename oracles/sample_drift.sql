WITH kept_customers AS (
  SELECT c_custkey FROM customer
  WHERE CAST(concat('0x', substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15)) AS BIGINT) < 230584300921369408
), shares AS (
  SELECT kind AS metric,
         (SELECT count(*) FILTER (WHERE event_type = substr(kind, 7)) / count(*) FROM events) AS "full",
         (SELECT count(*) FILTER (WHERE event_type = substr(kind, 7)) / count(*) FROM events
          WHERE user_id IN (SELECT c_custkey FROM kept_customers)) AS subset
  FROM (SELECT unnest(['share_view', 'share_error', 'share_click']) AS kind)
)
SELECT metric, "full", subset, round(subset - "full", 6) AS difference
FROM shares
