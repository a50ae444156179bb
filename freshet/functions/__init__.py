"""Column-level helpers: units, calendar, cleaning rules, distributions."""
