"""Metadata of runs: manifest edits, pruning, compaction policy."""
