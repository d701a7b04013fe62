"""Sources and sinks: files to texts, records to storage."""
