"""tapeline: market time-series analytics as lazy PySpark DataFrame operators."""
