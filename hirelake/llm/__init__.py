"""Operators for preparing training text: sharding, language, privacy, duplicates, mixing, tokens."""
