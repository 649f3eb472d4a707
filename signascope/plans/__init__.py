"""Plans of the signature engine."""
