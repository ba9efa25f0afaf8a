"""Relational operators over sequences, presence sets and panels."""
