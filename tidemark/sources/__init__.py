"""Readers and payload normalisers."""
