"""Sources (table scans, request readers, test-data bindings) and sinks."""
