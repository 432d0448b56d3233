"""Scalar expressions and the exponential mean."""
