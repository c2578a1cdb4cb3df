"""Episode analytics on PySpark: a library of DataFrame operators."""
