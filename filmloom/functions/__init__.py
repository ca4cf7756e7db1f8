"""Column expressions; everything here is lazy and row-local."""
