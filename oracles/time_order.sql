SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderdate AS parent_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate
