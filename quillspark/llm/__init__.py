"""Training-data operators: sanitising, filtering, deduplicating, mixing and encoding a corpus."""
