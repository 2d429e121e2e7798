"""Training-data operators: filters, extraction, near duplicates, scoring and mixing."""
