"""Time-series demand analytics expressed as Spark DataFrame plans."""
