"""Operators for preparing training data: near duplicates, search, filters, tokens, shards."""
