"""Operators for preparing training data. Nothing else in tessera imports this."""
