"""Operators for building training corpora: dedup, packing, filtering, scans and shards.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin ``opN_<name>`` queries over the given tables.
"""
