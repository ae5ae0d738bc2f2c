"""Column expressions: text, hashes, dates, weights, rounding, buckets and class probabilities."""
