"""Training-data operators: deduplication, sharding, extraction, licence scans,
language-model scoring, tokenisation, quality and decontamination."""
