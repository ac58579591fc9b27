"""Incremental counters, keyed windows and state that expires."""
