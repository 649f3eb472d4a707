"""Sources of the signature engine."""
