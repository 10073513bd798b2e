"""Column expressions: text, URLs and the page node array."""
