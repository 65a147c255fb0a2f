"""Training-data operators: URL filters, deduplication, scans, quality, packing, sharding."""
