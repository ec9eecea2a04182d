"""Training-data operators: archives, near-duplicates, classifiers, rules, packing, mixing, chat formatting.

Nothing outside this subpackage imports it, so that it can be removed whole.
"""
