"""Readers: parquet tables, nested JSON knowledge bases, ragged TSV, JSON lines, chunked files."""
