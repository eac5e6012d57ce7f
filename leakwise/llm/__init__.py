"""Training-data operators: chat formatting, language ID, dedup, licence scans, quality, LM scores, mixing, rules, packing.

Nothing else in the library imports this subpackage; ``queries.py`` holds the registered queries and their SQL.
"""
