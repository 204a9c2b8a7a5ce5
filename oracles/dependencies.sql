-- Classes of rows in every set of the eight columns, by a cube; a bit of `s` is a column of the set.
WITH wide AS (
    SELECT l_orderkey, l_suppkey, o_custkey, o_orderdate, c_nationkey, c_mktsegment, n_name, n_regionkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
),
sets AS (
    SELECT 255 - g AS s, count(*) AS classes
    FROM (
        SELECT GROUPING(l_orderkey, l_suppkey, o_custkey, o_orderdate, c_nationkey, c_mktsegment, n_name, n_regionkey) AS g
        FROM wide
        GROUP BY CUBE (l_orderkey, l_suppkey, o_custkey, o_orderdate, c_nationkey, c_mktsegment, n_name, n_regionkey)
    )
    GROUP BY g
),
names AS (
    SELECT place, name, CAST(1 << (8 - place) AS BIGINT) AS bit
    FROM (VALUES (1, 'l_orderkey'), (2, 'l_suppkey'), (3, 'o_custkey'), (4, 'o_orderdate'), (5, 'c_nationkey'),
        (6, 'c_mktsegment'), (7, 'n_name'), (8, 'n_regionkey')) AS t (place, name)
),
follows AS (
    SELECT x.s, x.classes, bit, name
    FROM sets x JOIN names ON x.s & bit = 0
    JOIN sets y ON y.s = x.s + bit AND y.classes = x.classes
    WHERE bit_count(x.s) <= 2 AND x.classes < (SELECT count(*) FROM wide)
)
SELECT
    coalesce((SELECT string_agg(n.name, ',' ORDER BY n.place) FROM names n WHERE f.s & n.bit <> 0), '') AS columns,
    f.name AS determines
FROM follows f
WHERE NOT EXISTS (SELECT 1 FROM follows p WHERE p.bit = f.bit AND p.s <> f.s AND p.s & f.s = p.s)
