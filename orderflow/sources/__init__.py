"""Readers and writers: CSV edges, staged Parquet tables, the shared folder."""
