"""Training-data operators: sharding, deduplication, media, mixing, PII, fingerprints, token files, SentencePiece, toxicity.

Nothing else in the library imports this subpackage.
"""
