"""rolemill: job-posting ETL, rating and reporting as Spark jobs."""
