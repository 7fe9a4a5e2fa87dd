"""Training-data operators: archives, deduplication, classification, scanning, tokenisation and packing."""
