"""Operators on training text: scans, de-duplication, mixing, sharding and archives."""
