"""Operators for building training data, apart from the procurement engine."""
