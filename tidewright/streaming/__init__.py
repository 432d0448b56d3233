"""Bars that arrive over time."""
