"""Sources and sinks: partition-list Parquet scan, text files, result sink."""
