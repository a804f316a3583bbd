"""Operators for preparing training text: fingerprints, near duplicates, tokens, mixtures."""
