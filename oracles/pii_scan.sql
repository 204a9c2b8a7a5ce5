SELECT 'email' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'ip' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(sum(len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'phone' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(sum(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))) AS BIGINT) AS hits
FROM documents
