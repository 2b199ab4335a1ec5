"""Progress analytics over submission logs, as plain PySpark DataFrame jobs."""
