"""Column helpers: text surfaces, word tests, buckets, labels."""
