"""DataFrame operators, one module per subject."""
