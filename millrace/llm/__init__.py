"""Training-data operators: PII, nearest neighbours, near duplicates, language models, mixing, packing."""
