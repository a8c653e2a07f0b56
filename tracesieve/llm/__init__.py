"""Operators for training-data pipelines: text, links, packing and files.  Nothing outside imports this package."""
