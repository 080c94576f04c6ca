"""Training-data operators: fingerprints, archives, token counts, joins, filters, packing and mixing.

Nothing outside this package imports it.
"""
