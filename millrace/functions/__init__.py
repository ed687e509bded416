"""Column expressions: value rules, eligibility predicates and text patterns."""
