"""Operators for preparing training data: filters, duplicates, archives, mixing, tokens."""
