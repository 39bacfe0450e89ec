"""Changes that arrive in batches."""
