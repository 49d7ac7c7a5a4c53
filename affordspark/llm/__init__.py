"""Training-data operators (n-gram joins, chat formatting, tokenization,
URL rules, quality rules, language ID, LM scoring, fingerprints, mixing).

Nothing else in the library imports this subpackage.
"""
