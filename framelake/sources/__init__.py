"""Readers and writers for image corpora."""
