"""Operators of a training-data pipeline: deduplication, decontamination, tokenization, classification, scans."""
