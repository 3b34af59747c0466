"""Operators for preparing training text: counts, fingerprints, packing, joins, search.

Nothing outside this package imports it."""
