"""Column expressions: message scoring, recognition, redaction, terms, stable ids."""
