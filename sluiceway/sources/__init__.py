"""Readers: files, databases, web APIs and literal rows."""
