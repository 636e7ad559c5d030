"""Column functions: statistics, weights, URLs, text."""
