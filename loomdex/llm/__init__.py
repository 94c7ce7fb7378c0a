"""Operators for preparing training data; nothing else in loomdex imports this package."""
