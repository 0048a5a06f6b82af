"""Operators for training-data pipelines (toxicity, near duplicates, packing, ...).

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it is present.
"""
