"""Point-in-time analytics over two-sided contests, written on the Spark DataFrame API."""
