"""Clinical-trial data-quality checks as Spark DataFrame jobs."""
