"""Sources and sinks: files, dimensions, reports, diffs, and relations derived from the given tables."""
