"""Operators for preparing large text and embedding collections for model training."""
