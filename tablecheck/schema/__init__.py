"""Declared schemas: reading and comparing."""
