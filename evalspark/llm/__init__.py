"""Training-data operators: deduplication, decontamination, classifiers,
search, packing, sharding and licence scans.

Nothing else in the library imports this package. ``llm.queries`` holds the
registered queries and their SQL.
"""
