"""Whole runs: datasets, the screening rounds, the embedding layers, reports."""
