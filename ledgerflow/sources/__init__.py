"""Sources and sinks: table scans, fixture views, bronze discovery, writers."""
