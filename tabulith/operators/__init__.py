"""DataFrame operators, one module for each stage of table reconstruction."""
