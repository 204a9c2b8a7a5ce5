SELECT * FROM part
