"""Operators of a training-data pipeline: language ID, de-duplication, sharding, packing, quality, encoding, scoring, PII.

Nothing else in the library imports this subpackage.
"""
