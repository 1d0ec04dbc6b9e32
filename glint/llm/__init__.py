"""Training-data operators: tokenising, extraction, archives, sharding, filtering and near-duplicates.

Nothing else in the library imports this subpackage.
"""
