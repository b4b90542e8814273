"""Training-data operators: token shards, mixing, secret scans, dedup, packing, media, language and quality models."""
