"""Transaction features, validation and scoring as Spark DataFrame jobs."""
