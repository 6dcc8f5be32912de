"""sources of the orbital-catalogue engine."""
