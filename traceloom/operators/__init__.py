"""Table operators, one module per area."""
