"""Operators for large text corpora: tokenizing, packing, deduplication, classifiers, sharding and vector search."""
