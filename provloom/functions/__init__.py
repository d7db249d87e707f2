"""Column functions: plain Catalyst expressions, no Python in the row path."""
