"""Sources and sinks: parquet tables, CSV, JSON, JDBC, workbooks and zipped CSV."""
