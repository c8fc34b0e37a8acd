"""postloom: job-posting analytics as PySpark DataFrame and Structured Streaming jobs."""
