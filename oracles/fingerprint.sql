WITH digests AS (
  SELECT md5(concat_ws(chr(31), l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CAST(floor(l_quantity * 10000 + 0.5) AS BIGINT),
           CAST(floor(l_extendedprice * 10000 + 0.5) AS BIGINT),
           CAST(floor(l_discount * 10000 + 0.5) AS BIGINT),
           CAST(floor(l_tax * 10000 + 0.5) AS BIGINT),
           l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f'))) AS d
  FROM lineitem
)
SELECT count(*) AS "rows",
       CAST(sum(CAST(concat('0x', substr(d, 1, 8)) AS BIGINT)) AS VARCHAR) AS hash_1,
       CAST(sum(CAST(concat('0x', substr(d, 9, 8)) AS BIGINT)) AS VARCHAR) AS hash_2
FROM digests
