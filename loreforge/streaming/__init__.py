"""Loreforge streaming."""
