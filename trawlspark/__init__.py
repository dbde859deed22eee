"""Full-text search, ranking and retrieval evaluation as Spark DataFrame operations."""

__version__ = "0.1.0"
