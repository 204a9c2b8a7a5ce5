WITH a AS (
  SELECT *, count(*) AS copies FROM lineitem GROUP BY ALL
), b AS (
  SELECT * REPLACE (CASE l_returnflag WHEN 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag),
         count(*) AS copies
  FROM lineitem GROUP BY ALL
)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
       coalesce(a.copies, 0) AS copies_a, coalesce(b.copies, 0) AS copies_b
FROM a FULL JOIN b USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
WHERE coalesce(a.copies, 0) <> coalesce(b.copies, 0)
