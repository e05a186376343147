"""Column expressions: prices, books, sides, rounding, quoting rules."""
