"""Registered queries and measurements."""
