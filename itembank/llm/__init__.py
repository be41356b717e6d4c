"""Training-data operators: extraction, near duplicates, tokens, scans and quality."""
