"""functions of the signal-research library."""
