"""Point-in-time equity datasets, labels, models and trade evaluation as Spark jobs."""
