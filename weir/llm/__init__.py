"""Operators for training-data preparation; nothing else in weir imports them."""
