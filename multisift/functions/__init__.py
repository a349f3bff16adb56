"""Column functions: deterministic randomness, tail probabilities and multiple testing."""
