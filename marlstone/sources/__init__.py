"""sources of the signal-research library."""
