"""Column functions: names, seeds, JSON, probabilities and small grids."""
