"""Operators for preparing training text: tokenising, extraction, sharding, search, scans, deduplication and filtering."""
