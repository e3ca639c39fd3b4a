"""Column expressions: text, report parsing, paths, presentation."""
