"""Report queries composed from the operators."""
