"""Operators for large text corpora: token counts, decontamination, near-duplicates, packing, sharding, mixing, scoring.

Nothing else in the library imports this subpackage; its queries are in ``loomgraph.llm.queries``.
"""
