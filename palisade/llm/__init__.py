"""Training-data operators: quality, deduplication, decontamination, mixing, packing and language modelling.

Nothing else in the library imports this subpackage.
"""
