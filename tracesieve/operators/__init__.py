"""Screening operators, DataFrame to DataFrame."""
