"""Transaction-risk analytics as PySpark DataFrame operators."""
