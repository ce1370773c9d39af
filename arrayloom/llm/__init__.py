"""Training-data operators: deduplication, decontamination, filtering, tokenisation and search."""
