"""operators of the signal-research library."""
