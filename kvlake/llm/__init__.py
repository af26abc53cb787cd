"""Operators for preparing training corpora; self-contained and optional."""
