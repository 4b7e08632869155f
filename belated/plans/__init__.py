"""Registered queries over the sample tables."""
