"""Composite commands."""
