"""Column functions: text keys, readings, numerals, address tails, geometry."""
