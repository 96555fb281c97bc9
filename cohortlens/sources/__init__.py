"""Sources and sinks: declared-schema table reads, crosswalk views, nested JSON, publish."""
