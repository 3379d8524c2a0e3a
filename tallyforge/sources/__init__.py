"""Readers of logs, tables and catalogue dumps."""
