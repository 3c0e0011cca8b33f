"""Volume sources, table readers and sinks."""
