"""DataFrame-in, DataFrame-out operators, one module per area."""
