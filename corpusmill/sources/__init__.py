"""Sources and sinks: raw files, the chunk store, the vector table, the manifest, service state."""
