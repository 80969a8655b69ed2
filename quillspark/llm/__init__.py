"""Training-data operators: packing, deduplication, scoring, filtering and media columns."""
