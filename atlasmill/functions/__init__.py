"""Column builders: text, geography, opening hours, categories, decisions."""
