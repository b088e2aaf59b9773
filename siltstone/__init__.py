"""siltstone: warehouse-style data processing on plain Apache Spark."""
