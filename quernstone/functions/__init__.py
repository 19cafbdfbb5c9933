"""Column builders: vector arithmetic and text."""
