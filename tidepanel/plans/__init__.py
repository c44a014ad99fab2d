"""Named factors, as expressions."""
