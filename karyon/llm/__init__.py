"""Operators of a training-data pipeline over `documents`, `pages` and `conversations`.

Nothing outside this package imports it.
"""
