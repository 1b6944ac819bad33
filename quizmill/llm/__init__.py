"""Training-data operators: scans, filters, deduplication, archives, fingerprints, sharding and mixing."""
