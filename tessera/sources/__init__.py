"""Readers, writers, and the test tables seen as review data."""
