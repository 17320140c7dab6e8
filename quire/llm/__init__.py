"""Training-data operators: sharding, decontamination, near-dedup, PII, search, toxicity, chat, mixing, token output."""
