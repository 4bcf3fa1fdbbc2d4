"""Training-data operators: counting, packing, mixing, sharding, filtering and deduplication of documents."""
