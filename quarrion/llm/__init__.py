"""Training-data operators: scans, deduplication, mixing, language ID, decontamination, LM scoring, extraction."""
