"""Operators for training-data pipelines: filters, dedup, extraction, packing, stores."""
