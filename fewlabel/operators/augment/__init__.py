"""Table-driven text augmentation: plan, candidate tables, substitution, summaries."""
