"""Operators for preparing training text: deduplication, decontamination, filtering, formatting and tokenising."""
