"""Operators for training-data pipelines: scoring, deduplication, decontamination, search and tokenizers."""
