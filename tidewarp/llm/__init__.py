"""Training-data operators: search, similarity joins, sharding, archives, secret scans,
packing, de-duplication, mixing and toxicity scoring over text tables.

Nothing else in the library imports this subpackage.
"""
