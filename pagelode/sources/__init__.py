"""Readers and preparation of the four relations."""
