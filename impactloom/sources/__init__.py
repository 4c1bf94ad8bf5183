"""Sources and sinks: files, reports, merges into tables."""
