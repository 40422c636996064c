"""Operators on texts and entities for training data."""
