"""Relational operators on named columns."""
