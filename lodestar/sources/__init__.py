"""Sources and sinks: storage, JSON lines, rendering."""
