"""Walk exploration analytics as PySpark jobs."""
