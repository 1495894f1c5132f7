"""Training-data operators: language id, mixing, decontamination, dedup, scoring, search.

Nothing else in the library imports this subpackage.
"""
