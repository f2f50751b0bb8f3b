"""Cohort and survival statistics as distributed DataFrame operators."""

__version__ = "0.1.0"
