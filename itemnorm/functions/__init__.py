"""Column expressions: text keys, similarity measures, word rules and attribute rules."""
