"""Training-data operators: quality, dedup, media, tokens, privacy, archives, packing.

Every module keeps the same shape: a general operator over any DataFrame, and a
thin ``opN_*`` query in :mod:`lexiloom.llm.entry` that derives digest columns
from the operator's real output.  Nothing outside this package imports it.
"""
