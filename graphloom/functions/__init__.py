"""Statistics over graphs."""
