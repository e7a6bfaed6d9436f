"""Training-data operators: quality, similarity search, PII, language models, licences,
toxicity, near-duplicates, mixing, chat repair and decontamination.

Nothing outside this subpackage imports it.
"""
