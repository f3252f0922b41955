"""Entity resolution and incremental ingestion as set-based Spark transformations."""
