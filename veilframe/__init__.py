"""veilframe: privacy-risk analytics over text, written as Spark DataFrame jobs."""
