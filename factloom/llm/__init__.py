"""Training-data operators: scans, filters, near-duplicates, mixing, formatting, media."""
