"""Loreforge functions."""
