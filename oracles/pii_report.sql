SELECT 'customer' AS "table", 'c_name' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_name, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_name, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'customer' AS "table", 'c_name' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_name, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_name, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'customer' AS "table", 'c_name' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_name, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_name, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'customer' AS "table", 'c_mktsegment' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_mktsegment, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_mktsegment, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'customer' AS "table", 'c_mktsegment' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_mktsegment, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_mktsegment, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'customer' AS "table", 'c_mktsegment' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(c_mktsegment, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(c_mktsegment, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM customer
UNION ALL
SELECT 'documents' AS "table", 'text' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'text' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'text' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(text, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'lang' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(lang, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(lang, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'lang' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(lang, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(lang, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'lang' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(lang, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(lang, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'source' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(source, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(source, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'source' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(source, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(source, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'documents' AS "table", 'source' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(source, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(source, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM documents
UNION ALL
SELECT 'part' AS "table", 'p_name' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_name, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_name, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_name' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_name, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_name, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_name' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_name, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_name, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_brand' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_brand, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_brand, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_brand' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_brand, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_brand, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_brand' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_brand, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_brand, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_type' AS "column", 'email' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_type, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_type, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_type' AS "column", 'ip' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_type, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_type, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'))), 0) AS BIGINT) AS hits
FROM part
UNION ALL
SELECT 'part' AS "table", 'p_type' AS "column", 'phone' AS pattern,
       count(*) FILTER (WHERE regexp_matches(p_type, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}')) AS "rows",
       CAST(coalesce(sum(len(regexp_extract_all(p_type, '[0-9]{3}-[0-9]{3,4}-[0-9]{4}'))), 0) AS BIGINT) AS hits
FROM part
