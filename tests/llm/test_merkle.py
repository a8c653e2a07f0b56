"""The dataset manifest against trees built in plain Python."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tracesieve.llm import merkle
from tracesieve.llm.queries import QUERIES


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fanout):
    """The root, and for every leaf its way up as (siblings before, siblings after)."""
    ways, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for way, i in zip(ways, at):
            run = i - i % fanout
            way.append(("".join(now[run:i]), "".join(now[i + 1 : run + fanout])))
        now = [H("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)]
        at = [i // fanout for i in at]
    return now[0], ways


def fold(h, way):
    for before, after in way:
        h = H(before + h + after)
    return h


def brute(rows, fanout=3):
    """Per row: key, leaf, subroot, root, proof, folded root, verified."""
    groups = defaultdict(list)
    for row in rows:
        key, text = row[0], row[4]
        cut = text is not None and key is not None and zlib.crc32(str(key).encode()) % 2 == 0
        groups[row[1]].append((key, leaf_of(row), leaf_of((*row[:4], text.replace("\n", "") if cut else text))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[name] = own, *tree([r[1] for r in own], fanout)
    root, above = tree([made[name][1] for name in names], fanout)
    out = []
    for name, over in zip(names, above):
        own, subroot, ways = made[name]
        for (key, leaf, other), way in zip(own, ways):
            again = fold(other, way + over)
            out.append((key, leaf, subroot, root, H("".join(a + b for a, b in way + over)), again, again == root))
    return out


COLUMNS = "doc_id long, source string, lang string, n_chars int, text string"


def check(spark, docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    got = [tuple(r) for r in merkle.verified(docs).collect()]
    assert Counter(got) == Counter(brute(rows))
    return got


def test_whole_documents_with_odd_rows(spark, documents):
    got = check(spark, documents)
    assert {r[6] for r in got} == {True, False}


def test_one_leaf_and_a_full_run_of_sources(spark):
    for n in (1, 3):
        check(spark, spark.createDataFrame([(i, str(i), None, i, "a\nb") for i in range(n)], COLUMNS))


def test_sources_null_empty_and_by_bytes(spark):
    names = [None, "", "a", "Z", "é", "\U0001f642", "￮", "ab", "a b", "-"]
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 30, 8]  # full and short runs on every level
    check(spark, spark.createDataFrame([(100 * i + j, s, "en", None, "x\n" * (j % 5)) for i, (s, n) in enumerate(zip(names, sizes)) for j in range(n)], COLUMNS))


def test_copies_null_keys_and_ties(spark):
    rows = [(1, "s", "en", 3, "a\nc")] * 11 + [(None, "s", None, None, None)] * 4 + [(1, "s", "en", 3, "other"), (None, None, None, None, ""), (2, "s", "", 0, "")]
    check(spark, spark.createDataFrame(rows, COLUMNS).repartition(4))


def test_one_group_with_most_rows_is_cut_into_ranges(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("same\n").alias("text"))
    again = docs.where("doc_id = 7").select("doc_id", "source", "lang", "n_chars", "text", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("col")
    both = docs.unionByName(again)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = merkle.numbered(merkle.written(both.withColumn("copy", F.monotonically_increasing_id()), "told"), ["source", "doc_id", "copy"], "order")
        sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 4000  # 3001 rows of one key are parted, and so is the group of 7500
    assert sorted(r["_at"] for r in placed.select("_at").collect()) == list(range(8000))
    check(spark, both)


def test_other_fanouts(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "en", 1, str(i)) for i in range(40)], COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    for fanout in (2, 4):
        got = merkle.manifest(docs, fanout=fanout).select("key", F.lower(F.hex("root")).alias("root"), F.lower(F.hex(merkle.folded(F.col("hash"), F.col("path")))).alias("again")).collect()
        want = brute(rows, fanout)[0][3]
        assert len(got) == 40 and all(r["root"] == want == r["again"] for r in got)
    with pytest.raises(ValueError):
        merkle.manifest(docs, fanout=1)


def test_a_changed_value_is_seen(spark):
    rows = [(1, "s", "en", 1, "text"), (2, "s", "en", 1, "text"), (1, "t", "en", 1, "text"), (1, "s", None, 1, "text"), (1, "s", "en", 11, "text"), (1, "s", "en", 1, "text "), (1, "s", "en", None, "text"), (1, "s", "en", 1, None), (1, "s", "en", 1, "-")]
    docs = spark.createDataFrame(rows, COLUMNS)
    digests = docs.select(merkle.hex_text(merkle.digest(merkle.record([F.col(c) for c in merkle.FIELDS])))).collect()
    assert [r[0] for r in digests] == [leaf_of(r) for r in rows] and len(set(digests)) == len(rows)
    roots = {merkle.verified(d).first()["root"] for d in (docs, docs.where("text <> 'text '"))}
    assert len(roots) == 2


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert merkle.verified(docs).collect() == []
    odd = spark.createDataFrame([(1, "s", "en", 1, "a\n"), (2, "s", "en", 1, "b")], COLUMNS)
    for c in ("tree", "idx", "size", "hash", "key", "group", "copy", "_id", "_at", "path", "root"):
        odd = odd.withColumn(c, F.lit("clash"))
    check(spark, odd)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute(rows))
