"""Training-data operators: sharding, scans, language, dedup, decontamination, tokens, HTML."""
