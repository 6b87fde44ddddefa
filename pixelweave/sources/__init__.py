"""Sources and sinks: image stacks, rasters, arrays, tables, archives, listings."""
