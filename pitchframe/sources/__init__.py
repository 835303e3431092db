"""Scans of landed files and the table sink."""
