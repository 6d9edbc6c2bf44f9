"""Sources and sinks: TMX translation memories, JSON lines, null sink."""
