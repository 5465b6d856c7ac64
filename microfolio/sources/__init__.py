"""Readers, writers, raw schemas and the views over the supplied test tables."""
