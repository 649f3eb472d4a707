"""Functions of the signature engine."""
