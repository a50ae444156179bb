"""Table-level operators, one module per subject."""
