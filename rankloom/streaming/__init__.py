"""Incremental ingestion by Structured Streaming, an extension of the batch build."""
