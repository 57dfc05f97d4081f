"""Query plans read back."""
