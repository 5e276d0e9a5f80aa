"""Pure functions: names, logical types, scalar parsing, and their column twins."""
