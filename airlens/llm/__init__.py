"""Operators of a training-data pipeline: cleaning, scoring, deduplication, counting and packing of documents."""
