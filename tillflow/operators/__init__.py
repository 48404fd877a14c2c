"""DataFrame -> DataFrame operators, one module per warehouse layer."""
