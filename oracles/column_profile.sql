SELECT 'o_orderkey' AS "column", count(*) AS "rows", count(o_orderkey) AS non_null, count(DISTINCT o_orderkey) AS "distinct",
       CAST(sum(strlen(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(o_orderkey AS VARCHAR))) AS INT) AS max_length
FROM orders
UNION ALL
SELECT 'o_custkey' AS "column", count(*) AS "rows", count(o_custkey) AS non_null, count(DISTINCT o_custkey) AS "distinct",
       CAST(sum(strlen(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(o_custkey AS VARCHAR))) AS INT) AS max_length
FROM orders
UNION ALL
SELECT 'o_orderstatus' AS "column", count(*) AS "rows", count(o_orderstatus) AS non_null, count(DISTINCT o_orderstatus) AS "distinct",
       CAST(sum(strlen(CAST(o_orderstatus AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(o_orderstatus AS VARCHAR))) AS INT) AS max_length
FROM orders
UNION ALL
SELECT 'o_orderpriority' AS "column", count(*) AS "rows", count(o_orderpriority) AS non_null, count(DISTINCT o_orderpriority) AS "distinct",
       CAST(sum(strlen(CAST(o_orderpriority AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(o_orderpriority AS VARCHAR))) AS INT) AS max_length
FROM orders
UNION ALL
SELECT 'o_totalprice' AS "column", count(*) AS "rows", count(o_totalprice) AS non_null, count(DISTINCT o_totalprice) AS "distinct",
       CAST(sum(strlen(CAST(CAST(floor(o_totalprice * 10000 + 0.5) AS BIGINT) AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(CAST(floor(o_totalprice * 10000 + 0.5) AS BIGINT) AS VARCHAR))) AS INT) AS max_length
FROM orders
UNION ALL
SELECT 'o_orderdate' AS "column", count(*) AS "rows", count(o_orderdate) AS non_null, count(DISTINCT o_orderdate) AS "distinct",
       CAST(sum(strlen(CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS VARCHAR))) AS BIGINT) AS bytes,
       CAST(max(strlen(CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS VARCHAR))) AS INT) AS max_length
FROM orders
