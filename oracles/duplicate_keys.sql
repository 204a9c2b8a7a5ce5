SELECT l_orderkey, l_linenumber, count(*) AS "rows"
FROM lineitem
GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1
