"""Operators for training data: deduplication, extraction, formatting, scoring, decontamination, packing.

Nothing else in courtside imports this subpackage. Each module holds one operator with a general
interface; ``queries`` applies each to its whole table.
"""
