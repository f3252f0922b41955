"""Training-data operators: toxicity, deduplication, formatting, language ID, tokenizing,
decontamination, personal data, fingerprints and similarity joins.

Nothing else in the library imports this subpackage.
"""
