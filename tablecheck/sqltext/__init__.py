"""SQL as text."""
