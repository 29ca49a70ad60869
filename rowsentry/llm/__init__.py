"""Training-data operators: filters, near-duplicate joins, tokenisation and packing.

Nothing else in the library imports this subpackage.
"""
