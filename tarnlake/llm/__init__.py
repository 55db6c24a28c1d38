"""Training-data operators: filtering, deduplication, scoring, encoding and packing of text."""
