"""Column expressions (no DataFrame work): hash keys, text and numeric helpers."""
