"""Siltstone: versioned key-value logs, their storage layout and their analytics on Spark."""
