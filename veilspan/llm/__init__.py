"""Operators of a training-data pipeline: near-duplicates, quality, tokens, licences, extraction, filters."""
