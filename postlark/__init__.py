"""postlark: job-posting analytics expressed as Spark DataFrame and SQL plans."""
