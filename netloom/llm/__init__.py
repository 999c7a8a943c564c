"""Training-data operators: quality, tokens, near-duplicates, shards, chat, toxicity, packing."""
