"""Operators for preparing training text: fingerprints, personal data, dedup, mixing, joins,
licences, tokenisation, toxicity, token attribution and language identification.

Nothing else in the library imports this subpackage.
"""
