"""Column functions: identity, time, text."""
