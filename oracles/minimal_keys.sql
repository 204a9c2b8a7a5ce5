-- Every set of one to three columns, by joining the values of a row with each other.
WITH numbered_orders AS (SELECT row_number() OVER () AS no, * FROM orders),
numbered_lines AS (SELECT row_number() OVER () AS no, * FROM lineitem),
cells AS (
    SELECT 'orders' AS tab, 3 AS largest, no, name, CAST(value AS VARCHAR) AS value
    FROM (SELECT no, COLUMNS(* EXCLUDE (no))::VARCHAR FROM numbered_orders)
    UNPIVOT (value FOR name IN (COLUMNS(* EXCLUDE (no))))
    UNION ALL
    SELECT 'lineitem', 2, no, name, CAST(value AS VARCHAR)
    FROM (SELECT no, COLUMNS(* EXCLUDE (no))::VARCHAR FROM numbered_lines)
    UNPIVOT (value FOR name IN (COLUMNS(* EXCLUDE (no))))
),
places (tab, place, name) AS (
    VALUES ('orders', 1, 'o_orderkey'), ('orders', 2, 'o_custkey'), ('orders', 3, 'o_orderstatus'),
        ('orders', 4, 'o_totalprice'), ('orders', 5, 'o_orderdate'), ('orders', 6, 'o_orderpriority'),
        ('lineitem', 1, 'l_orderkey'), ('lineitem', 2, 'l_partkey'), ('lineitem', 3, 'l_suppkey'),
        ('lineitem', 4, 'l_linenumber'), ('lineitem', 5, 'l_quantity'), ('lineitem', 6, 'l_extendedprice'),
        ('lineitem', 7, 'l_discount'), ('lineitem', 8, 'l_tax'), ('lineitem', 9, 'l_returnflag'),
        ('lineitem', 10, 'l_linestatus'), ('lineitem', 11, 'l_shipdate')
),
placed AS (SELECT * FROM cells JOIN places USING (tab, name)),
sets AS (
    SELECT tab, [name] AS columns, count(DISTINCT value) AS classes
    FROM placed GROUP BY ALL
    UNION ALL
    SELECT a.tab, [a.name, b.name], count(DISTINCT (a.value, b.value))
    FROM placed a JOIN placed b ON a.tab = b.tab AND a.no = b.no AND a.place < b.place
    GROUP BY ALL
    UNION ALL
    SELECT a.tab, [a.name, b.name, c.name], count(DISTINCT (a.value, b.value, c.value))
    FROM placed a JOIN placed b ON a.tab = b.tab AND a.no = b.no AND a.place < b.place
    JOIN placed c ON a.tab = c.tab AND a.no = c.no AND b.place < c.place
    WHERE a.largest = 3
    GROUP BY ALL
),
keys AS (
    SELECT tab, columns FROM sets
    JOIN (SELECT tab, count(DISTINCT no) AS n FROM cells GROUP BY tab) USING (tab)
    WHERE classes = n
)
SELECT tab AS "table", array_to_string(columns, ',') AS columns
FROM keys k
WHERE NOT EXISTS (
    SELECT 1 FROM keys s
    WHERE s.tab = k.tab AND len(s.columns) < len(k.columns) AND list_has_all(k.columns, s.columns)
)
