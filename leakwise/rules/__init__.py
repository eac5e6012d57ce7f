"""Rules as data: patterns, vendor rules, extension tables."""
