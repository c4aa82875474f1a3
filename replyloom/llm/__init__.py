"""Training-data operators: quality, toxicity, duplicates, contamination, URLs, mixing, sharding."""
