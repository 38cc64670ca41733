"""Readers and writers: parquet tables, raw JSON records, JSONL, CSV, YAML configs."""
