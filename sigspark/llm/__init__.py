"""Training-data operators: dedup, scoring, formatting, quality, mixing, counting, sharding, packing."""
