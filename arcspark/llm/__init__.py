"""Operators on training text and batch deduplication; nothing else in the package imports this one."""
