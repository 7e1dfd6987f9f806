"""Observation analytics on DataFrames: timed counters in, exact deltas, bounds and metrics out."""

__version__ = "0.1.0"
