"""Streaming of the signature engine."""
