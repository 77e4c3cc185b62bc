"""Episode segmentation and annotation analytics as Spark DataFrame operations."""
