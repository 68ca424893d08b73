"""Whole jobs: the import flow and the registered queries with their SQL twins."""
