"""Scans and sinks: raw CSV, parquet phase outputs, serving tables, and the
adapter views that map the driver's test tables onto the retail schema."""
