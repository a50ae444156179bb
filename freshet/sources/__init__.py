"""Readers for landed files and writers for products."""
