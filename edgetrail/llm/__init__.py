"""Operators for preparing training text: packing, scoring, de-duplication, extraction, archives, search."""
