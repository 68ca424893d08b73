"""Readers for delimited text, JSON, workbooks and stored tables."""
