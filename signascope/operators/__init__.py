"""Operators of the signature engine."""
