"""Readers, writers and row selections over trace tables."""
