"""Operators on texts and entities for training data; nothing else in lexspark imports this package."""
