"""A semantic-search analytics engine expressed as Spark DataFrame operations."""
