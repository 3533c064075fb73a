"""Operators for preparing large text corpora: search, packing, tagging, cleaning, encoding."""
