"""Operators for training-data pipelines: filters, deduplication, tokenizing, packing, extraction, archives."""
