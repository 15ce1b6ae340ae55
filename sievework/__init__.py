"""Document screening and talent analytics as Spark DataFrame jobs."""
