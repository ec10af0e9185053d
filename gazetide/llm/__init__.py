"""Operators for preparing training text: packing, search, filtering, de-duplication and formatting."""
