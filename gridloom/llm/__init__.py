"""Training-data operators: archives, deduplication, quality, decontamination, mixing, scoring."""
