"""Training-data operators: extraction, counting, scans, scoring, filtering, deduplication and mixing of large corpora."""
