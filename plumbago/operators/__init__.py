"""Relational operators over chunks, indexes, results and caches."""
