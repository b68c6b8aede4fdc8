"""Training-data operators: scans, decontamination, mixing, deduplication, scoring and writers.

Nothing outside this subpackage imports it.
"""
