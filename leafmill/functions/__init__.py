"""Column functions: normalisers, tokenisers, identifiers and scores."""
