"""Training-data operators: dedup, packing, filters, scoring, formatting, mixing.

Nothing outside this subpackage imports it.
"""
