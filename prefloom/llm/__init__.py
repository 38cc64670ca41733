"""Operators for training data: labels, answers, duplicates, splits, packing, mixing, personal information.

Nothing outside this package imports it.
"""
