"""Orbital-catalogue analytics as PySpark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame that covers the whole
catalogue at once; thresholds are keyword arguments.
"""
