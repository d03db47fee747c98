"""Loreforge sources."""
