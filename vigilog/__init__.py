"""vigilog: detection and analysis of threats in log data, as Spark DataFrame jobs."""
