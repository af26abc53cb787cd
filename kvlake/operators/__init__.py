"""Reads and writes of the versioned log as DataFrame operations."""
