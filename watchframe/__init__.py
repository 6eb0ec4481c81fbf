"""Camera analytics and table preparation as PySpark jobs."""
