"""Training-data operators (deduplication, scoring, mixing, sharding, ...).

Nothing else in the library imports this subpackage.
"""
