"""Training-data operators (language, duplicates, contamination, tokens, secrets ...).

Nothing outside this subpackage imports it.
"""
