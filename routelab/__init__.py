"""Analytics over model-evaluation facts and model-selection decisions, as Spark DataFrame jobs."""
