"""Sizes of the batches in which texts reach Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracesieve.session import ship

#: Bytes of a batch of documents or pages, about, unless the session sets another number than Spark's own.  One longer text is a batch alone.
BYTES = 3 << 20
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_own = {_DEFAULT}


def text_batches(texts: DataFrame, size: int = BYTES) -> None:
    """Make the package importable in workers, and batches small: memory follows a batch's bytes, whatever the lengths of its texts.

    Results are lazy, so the bound stays set in the session for as long as they may be read.  It changes no result, leaves the
    number of rows in a batch alone, and gives way to a bound that the caller has set.
    """
    spark = texts.sparkSession
    ship(spark)
    if spark.conf.get(_SETTING) in _own:
        spark.conf.set(_SETTING, str(size))
        _own.add(spark.conf.get(_SETTING))
