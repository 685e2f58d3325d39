"""Operators of a training-data pipeline: filtering, near duplicates, personal data, sharding, mixing, encoding."""
