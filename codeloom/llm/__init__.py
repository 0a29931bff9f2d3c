"""Training-data operators: quality, decontamination, toxicity, dedup, filters, sharding, tokens, HTML, LM.

Nothing outside this subpackage imports it.
"""
