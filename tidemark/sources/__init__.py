"""Readers and writers of record files."""
