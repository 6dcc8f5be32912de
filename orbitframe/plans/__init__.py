"""plans of the orbital-catalogue engine."""
