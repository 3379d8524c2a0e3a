"""Plans from raw logs to the store."""
