"""Operators for preparing training text; registered queries are in ``queries.py``."""
