"""Whole plans: ingest, retrieval, answers, and the registered queries."""
