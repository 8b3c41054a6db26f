"""plans of the signal-research library."""
