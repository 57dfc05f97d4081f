"""Relational and comparison operators."""
