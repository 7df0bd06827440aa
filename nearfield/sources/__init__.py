"""Readers and writers of vector and label files."""
