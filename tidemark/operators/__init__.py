"""Relational and portfolio operators."""
