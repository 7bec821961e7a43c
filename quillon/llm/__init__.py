"""Training-data operators: licence scans, similarity joins, packing, deduplication, decontamination, sharding, scoring."""
