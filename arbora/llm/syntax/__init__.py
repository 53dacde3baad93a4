"""Generalised LL parsing of source files."""
