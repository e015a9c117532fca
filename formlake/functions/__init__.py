"""Column expressions: parsing, positions and conditions."""
