"""Operators for building training data from large text collections.

Each module holds one operator with its own interface; ``queries`` applies them to
the driver's tables.  Nothing outside this folder imports it.
"""
