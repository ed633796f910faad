"""Training-data operators: quality, duplicates, packing, mixing, archives, storage."""
