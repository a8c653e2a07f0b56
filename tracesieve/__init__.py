"""Iterative, label-efficient screening of vectorised items on Spark.

Every operator takes and returns DataFrames.  The pool of items is the big side
and stays distributed; the labelled items are the small side and are broadcast
only behind a size check, with a tiled shuffle join beyond it.
"""

__version__ = "0.1.0"
