"""Operators that prepare training text: dedup, mixing, decontamination, language, sharding, joins, toxicity, tokens, PII.

Nothing else in the package imports this subpackage.
"""
