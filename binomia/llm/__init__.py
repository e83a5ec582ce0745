"""Training-data operators: dedup, archives, quality, tokenisation, personal data, packing, extraction, media.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
