"""Training-data operators: deduplication, filtering, search, scoring and mixing."""
