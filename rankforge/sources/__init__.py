"""Sources and sinks: parquet tables, nested JSON records, CSV, DOCX folders,
the embedding store, shortlist sinks and output checks."""
