"""Training-data operators: deduplication, filters, scoring, archives and packing."""
