"""Operators of a training-data pipeline over text; nothing else in the package imports this."""
