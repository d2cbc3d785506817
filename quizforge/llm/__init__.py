"""Training-data operators: deduplication, decontamination, scoring, encoding and packing.

Nothing outside this folder imports it.
"""
