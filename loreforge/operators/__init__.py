"""Loreforge operators."""
