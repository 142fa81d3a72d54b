"""Training-data operators: filters, classifiers, tokenizers, joins, mixing, sharding, search.

Self-contained: nothing else in the library imports this subpackage.
"""
