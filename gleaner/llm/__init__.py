"""Training-data operators: deduplication, packing, mixing, scoring, search and binary output at corpus scale.

Nothing else in the library imports this subpackage. Each ``opN_*`` module holds one operator with a general
interface and the thin query that the entry file registers.
"""
