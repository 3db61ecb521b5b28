"""Readers and writers: event logs, saved REST snapshots, the Parquet store."""
