"""Access-graph analytics and corpus preparation as PySpark jobs."""
