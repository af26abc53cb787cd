"""Column functions: key codec, prefixes and membership filters."""
