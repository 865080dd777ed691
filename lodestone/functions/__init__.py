"""Column expressions and the literals that go into them."""
