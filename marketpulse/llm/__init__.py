"""Operators for large-scale training text: filters, classifiers, joins and encodings."""
