"""Operators that prepare training text: duplicates, look-alikes, matching, clusters, vectors, packing, mixing, language."""
