"""File, payload and table sources."""
