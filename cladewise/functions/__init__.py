"""Column functions: names, probabilities, deterministic randomness."""
