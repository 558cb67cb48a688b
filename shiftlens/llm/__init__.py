"""Training-data operators: search, scoring, extraction, de-duplication, mixing, packing."""
