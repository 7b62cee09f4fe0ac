"""Training-data operators: scoring, deduplication, decontamination, privacy and mixing.

Nothing else in the library imports this subpackage.
"""
