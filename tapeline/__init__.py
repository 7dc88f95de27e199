"""tapeline: market-bar, signal and trade analytics as Spark DataFrame jobs."""
