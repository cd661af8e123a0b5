"""Relational operators over task records."""
