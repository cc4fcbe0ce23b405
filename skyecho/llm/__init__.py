"""Training-data operators: language, quality, archives, fingerprints, packing,
line and document de-duplication, vector search, byte-pair encoding, pseudonyms.

Nothing outside this subpackage imports it.
"""
