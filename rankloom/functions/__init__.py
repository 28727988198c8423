"""Column functions: text, scoring and vectors. All of them are built-in expressions; none calls Python per row."""
