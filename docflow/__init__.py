"""docflow: document-to-narration analytics as Spark DataFrame, SQL and streaming operations."""
