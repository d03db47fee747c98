"""Loreforge plans."""
