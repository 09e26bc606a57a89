"""Operators over documents, sentences and tokens."""
