"""Text-corpus operators: search, screening, deduplication, mixing, scoring and formatting."""
