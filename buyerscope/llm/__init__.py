"""Operators of a training-data pipeline: cleaning, identification, de-duplication, encoding, packing, sharding."""
