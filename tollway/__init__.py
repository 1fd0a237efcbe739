"""Budget-aware model-choice analytics expressed as Spark DataFrame jobs."""
