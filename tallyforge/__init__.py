"""Access analytics over web access logs, on Spark."""
