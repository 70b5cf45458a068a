"""Operators for training data from conversation archives."""
