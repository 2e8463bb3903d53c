"""Column expressions: measures, text, score distributions, labels and tail probabilities."""
