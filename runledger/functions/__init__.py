"""Scalar functions: column expressions, and driver-side text safety."""
