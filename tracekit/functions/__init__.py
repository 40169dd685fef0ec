"""Column expressions: cleaning, bins, geography, arrays."""
