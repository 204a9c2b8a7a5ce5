SELECT value, row_number() OVER (ORDER BY md5(value), value) AS id
FROM (SELECT DISTINCT c_name AS value FROM customer WHERE c_name IS NOT NULL)
