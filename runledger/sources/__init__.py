"""Sources: text formats with strict parsing, format detection, generators, and typed tables as cells."""
