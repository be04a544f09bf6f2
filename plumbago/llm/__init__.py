"""Operators for large training-corpus pipelines: deduplication, decontamination, scanning, scoring and mixing.

Nothing else in the library imports this subpackage.
"""
