"""Training-data operators: packing, sharding, mixing, scoring, de-duplication, privacy, language, search, quality."""
