"""Structured Streaming: file ingestion with availableNow and scoring with
frozen batch state, upserted per micro-batch."""
