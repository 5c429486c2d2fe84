"""Training-data operators: PII, deduplication, quality, packing, language-model scoring and more."""
