"""Versioned key-value tables on DataFrames."""
