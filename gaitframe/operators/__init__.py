"""Relational operators over observation tables."""
