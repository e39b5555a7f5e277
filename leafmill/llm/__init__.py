"""Training-data operators: quality, language, media, licences, pieces, near duplicates, sketches, URLs, tokens, mixing.

Nothing outside this subpackage imports it.
"""
