"""Continuous ingestion of arriving files with the same merge and gate rules as scheduled loads."""
