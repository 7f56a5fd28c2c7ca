"""Readers, and the views that stand for the memory tables."""
