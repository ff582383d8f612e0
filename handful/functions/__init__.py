"""Column expressions: seeded order, vectors, text and scalar clean-up."""
