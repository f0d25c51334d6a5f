"""Readers, writers and the views that derive asset inputs from the test tables."""
