"""functions of the orbital-catalogue engine."""
