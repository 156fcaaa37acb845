"""Sources and sinks: file tables, upload manifest, extracted cells / lines, result tables."""
