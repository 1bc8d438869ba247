"""Gated staged analytics as plain DataFrame code."""

__version__ = "0.1.0"
