"""Training-data operators: deduplication, filtering, redaction, scoring, formatting, mixing."""
