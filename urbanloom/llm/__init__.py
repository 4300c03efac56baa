"""Training-data operators: media, sharding, mixing, search, dedup, packing, PII, quality, licenses, token files."""
