"""Training-data operators: scoring, search, packing, deduplication, mixing, filtering."""
