"""Column functions: text, comparison."""
