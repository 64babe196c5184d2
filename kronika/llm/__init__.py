"""Operators for preparing training text and records. Nothing outside this folder imports it."""
