"""Operators for language-model training data; nothing outside imports this package."""
