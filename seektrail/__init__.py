"""Search-behaviour analytics as PySpark DataFrame operators."""
