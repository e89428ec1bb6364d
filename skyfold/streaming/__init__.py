"""Time averaging of a stream of measurement rows (an extension)."""
