"""Portfolio accounting and order flow as Spark DataFrame jobs."""
