import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A few hundred real documents, with nulls, empty and very long texts, repeats, ties and columns of clashing names."""
    from pyspark.sql import functions as F

    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"w{i} and the" for i in range(60_000))
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, " \n\t ", "en", "s", 4), (None, "no key here", None, None, 11), (9005, long, "en", "s", len(long)), (9006, "\U0001f642 naïve 日本 x", "en", "s", 12)],
        read.schema,
    )
    again = read.limit(7)
    return read.unionByName(odd).unionByName(again).withColumn("row", F.lit("r")).withColumn("fp", F.lit(1)).withColumn("_row", F.lit(None).cast("string")).withColumn("score", F.lit(0.5)).repartition(5).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
