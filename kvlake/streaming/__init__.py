"""The log as a stream (an extension)."""
