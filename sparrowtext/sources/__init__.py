"""Readers of corpora and the index directory."""
