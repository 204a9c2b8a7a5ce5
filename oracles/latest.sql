SELECT o.*
FROM orders o
WHERE NOT EXISTS (
  SELECT 1 FROM orders later
  WHERE later.o_custkey = o.o_custkey
    AND (later.o_orderdate, later.o_orderkey) > (o.o_orderdate, o.o_orderkey))
