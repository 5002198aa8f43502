"""Sources and sinks: JSON lines, CSV with a manifest, JSON to rows, and stored chunk texts."""
