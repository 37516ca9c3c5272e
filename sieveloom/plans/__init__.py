"""Plan-level helpers: partitioning, shared storage, worker setup, and whole retrieval pipelines."""
