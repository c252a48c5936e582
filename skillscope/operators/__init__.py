"""Reusable DataFrame operators: exact distributed ranking, dictionary
tagging, hash sampling/splitting, join helpers."""
