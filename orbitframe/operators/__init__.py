"""operators of the orbital-catalogue engine."""
