"""streaming of the orbital-catalogue engine."""
