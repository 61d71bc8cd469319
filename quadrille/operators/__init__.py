"""Operators on solution mappings and quads."""
