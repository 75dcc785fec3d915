"""Column expressions: cleaning rules, posting features and text signals."""
