"""Queries over the driver tables: each operator on stand-in series, with its SQL twin."""
