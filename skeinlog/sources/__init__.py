"""Readers and writers of logs and dimension files."""
