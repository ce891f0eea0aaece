"""Operators for preparing training text: archives, quality, duplicates, packing, counts, fingerprints, toxicity."""
