"""Near-duplicates, components, decontamination and exact search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracesieve.llm import decontaminate as clean, fingerprints as prints, knn
from tracesieve.llm.components import components


def slow_simhash(text, shingle):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB İé\t\x0b\x85 z", max_size=40))
def test_simhash(text):
    assert prints.simhash(text.encode(), 3) == slow_simhash(text, 3)


def test_simhash_of_long_texts_in_runs(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(2000))
    whole = prints.simhash(text.encode(), 3)
    monkeypatch.setattr(prints, "RUN", 97)
    assert prints.simhash(text.encode(), 3) == whole == slow_simhash(text, 3)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_set_of_bits(radius):
    masks = prints.covering_masks(radius)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not m & bits for m in masks)


def groups(found, radius=3):
    """Component of each row: the smallest key reachable, by comparing all pairs."""
    keys, fps = [k for k, _ in found], np.array([f for _, f in found], "<u8")
    parent = list(range(len(found)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius):
            a, b = sorted((top(i), top(int(j))))
            parent[b] = a
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [least.get(top(i)) for i in range(len(keys))]


def test_near_duplicates(documents, rows):
    found = [(k, slow_simhash(t, 3) if len(t or "") < 50_000 else prints.simhash(t.encode(), 3)) for k, t in rows]
    want = Counter((k, f if f < 1 << 63 else f - (1 << 64), g) for (k, f), g in zip(found, groups(found)))
    got = prints.near_duplicates(documents).collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == want


def test_one_of_each_group_stays(documents, rows):
    found = [(k, prints.simhash((t or "").encode(), 3)) for k, t in rows]
    kept = prints.keep_one(documents)
    assert kept.columns == documents.columns and kept.dtypes == documents.dtypes
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(groups(found)))


def test_group_without_keys_keeps_one_row(spark):
    table = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other text than that")], "doc_id long, text string")
    assert sorted(r["text"] for r in prints.keep_one(table).collect()) == ["a b c d", "other text than that"]
    assert prints.keep_one(table.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [2, 5, 256])
def test_links_of_large_buckets_join_the_same(spark, chunk):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(62, rng.integers(0, 3), replace=False)) for b in base for _ in range(40)})
    links = prints.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, chunk=chunk)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(f, f) for f in fps] == groups([(f, f) for f in fps])


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3), (7, 6), (0, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def slow_pairs(docs, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    texts = {}
    for i, t in items:
        if cut(t):
            texts[tuple(cut(t))] = min(i, texts.get(tuple(cut(t)), i))
    for d, t in docs:
        words = cut(t)
        for item, i in texts.items():
            want, n = shingles(list(item)), len(item)
            for s in range(max(1, len(words) - n + 1)):
                own = shingles(words[s : s + n])
                if words and sum((own & want).values()) >= 0.8 * sum((own | want).values()):
                    yield d, i
                    break


def test_contaminated(spark):
    rng = np.random.default_rng(2)
    word = lambda: "w" + "abcdefghijkl"[rng.integers(12)] + str(rng.integers(40))
    item = lambda n: [word() for _ in range(n)]
    items = [item(n) for n in (60, 61, 45, 45, 6, 3, 1, 30)]
    items[6] = ["single"]
    docs = []
    for n, own in enumerate(items):
        docs.append(item(20) + own + item(20))
        docs.append(own)
        docs.append(item(9) + own[:-1] + ["changed"] + item(3))  # the last word differs
        docs.append(item(9) + own[: len(own) // 2] + ["added"] + own[len(own) // 2 :] + item(3))
        docs.append(item(2) + own[: int(len(own) * 0.9)])  # cut off
        docs.append(item(2) + own[: int(len(own) * 0.6)] + item(30))
        docs.append(own * 2 + own[:4])
    docs += [item(70) for _ in range(20)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(500, None), (501, ""), (None, " ".join(items[0])), (3, docs and " ".join(docs[3])), (502, "Single!")]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(99, " ".join(items[2]).upper() + "."), (98, None), (97, ""), (96, "?!")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit("clash")).withColumn("item", F.lit(1)).repartition(4)
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = clean.contaminated(table, benchmark).collect()
    want = set(slow_pairs(rows, bench))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    kept = clean.decontaminate(table, benchmark)
    bad = {d for d, _ in want}
    assert kept.columns == table.columns and {r["_row"] for r in kept.collect()} == {"clash"}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad)


def slow_best(docs, items):
    """The best of all windows of each pair, and the first such window."""
    for d, t in docs:
        for i, x in items:
            words, want = t.split(), shingles(x.split())
            n, found = sum(want.values()) + 4, {}
            for s in range(max(1, len(words) - n + 1)):
                own = shingles(words[s : s + n])
                same = sum((own & want).values())
                found[s] = same / (sum(own.values()) + sum(want.values()) - same)
            s = max(found, key=lambda s: (found[s], -s))
            if found[s] >= 0.8:
                yield d, i, round(found[s], 9), s


@pytest.mark.parametrize("width", [16, 32])
def test_windows_of_a_run_have_their_own_fingerprints(spark, width):
    rng = np.random.default_rng(9)
    runs, want = [], {}
    for row, (n, k, first, size, starts) in enumerate([(12, 5, 3, 60, [3, 4, 7, 30, 51]), (3, 3, 0, 40, list(range(38))), (1, 1, 5, 4, [5, 6, 8]), (50, 5, 0, 20, [0]), (300, 5, 10, 700, [10, 11, 12, 400, 410]), (9, 5, 0, 2, [0])]):
        words = [f"w{i}" for i in rng.integers(0, 30, size)]
        runs.append((row, n, k, first, starts, words))
        want |= {(row, s): words[s - first : s - first + n] for s in starts}
    got = {(r["_row"], r["start"]): r["fp"] for r in clean._window_prints(spark.createDataFrame(runs, "_row long, n int, k int, first int, starts array<int>, words array<string>"), width).collect()}
    direct = clean._prints(spark.createDataFrame([(*key, words, runs[key[0]][2]) for key, words in want.items()], "_row long, start int, words array<string>, k int"))
    assert got == {(r["_row"], r["start"]): r["fp"] for r in direct.collect()}


def test_reordered_passages(spark):
    rng = np.random.default_rng(11)
    other = lambda n: [f"x{i}" for i in rng.integers(0, 10**6, n)]
    docs, bench = [], []
    for i, (n, cut) in enumerate([(40, 12), (50, 20), (59, 25), (100, 45), (80, 40)]):
        item = [f"w{i}n{j}" for j in range(n)]
        bench.append((i, " ".join(item)))
        swapped = item[cut:] + item[:cut]
        docs += [(10 * i, other(150) + swapped + other(150)), (10 * i + 1, swapped), (10 * i + 2, other(n) + swapped), (10 * i + 3, swapped + other(3) + swapped + other(9))]
        docs += [(10 * i + 4, item[: n // 2] + other(n)), (10 * i + 5, other(7) + item * 3), (10 * i + 6, item[4:])]
    bench.append((90, "p q r s t " * 12 + "u v"))  # shingles that repeat
    docs += [(900, other(30) + ["p", "q", "r", "s", "t"] * 30), (901, ["p", "q", "r", "s", "t"] * 9 + other(20))]
    rows = [(d, " ".join(words)) for d, words in docs]
    want = set(slow_best(rows, bench))
    assert {(d, i) for d, i, *_ in want} >= {(10 * i, i) for i in range(5)} | {(900, 90)}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start_word"]) for r in clean.contaminated(table, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["doc_id"] for r in clean.decontaminate(table, benchmark).collect()} == {d for d, _ in rows} - {d for d, *_ in want}


def test_real_documents_and_empty_sides(spark, documents, rows):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    short = [(k, t) for k, t in rows if len(t or "") < 4000]
    got = clean.contaminated(documents, benchmark).collect()
    ids = {k for k, _ in short}
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] in ids} == set(slow_pairs(short, [tuple(r) for r in benchmark.collect()]))
    assert clean.contaminated(documents.where("false"), benchmark).count() == 0
    assert clean.contaminated(documents, benchmark.where("false")).count() == 0
    assert clean.decontaminate(documents, benchmark.where("false")).count() == documents.count()


def slow_top(rows, k):
    vectors = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((key, [math.floor(256 * x) for x in v]))
    out = {}
    for q, v in vectors:
        if q % 50 == 0:
            best = out.setdefault(q, {})
            for d, w in vectors:
                if d != q:
                    best[d] = max(sum(a * b for a, b in zip(v, w)), best.get(d, -(1 << 70)))
    return {(q, n + 1, d, s) for q, best in out.items() for n, (d, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}


@pytest.mark.parametrize("task_bytes", [knn.TASK_BYTES, 280, 80])
def test_top_k(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(knn, "TASK_BYTES", task_bytes)
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 3, (6, 5))
    rows = [(int(i), [float(x) for x in middle[i % 6] + rng.normal(0, 0.2, 5)]) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(1000, 1060)]  # one vector many times: ties go to the smaller key
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 5), (2150, [float("inf")] * 5), (None, [1.0] * 5), (2200, [1.0, 2.0]), (2250, []), (50, rows[7][1]), (60, rows[8][1]), (60, rows[8][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("group", F.lit("clash")).repartition(5)
    for k in (5, 500):
        got = [tuple(r) for r in knn.top_k(table, F.col("vec_id") % 50 == 0, k=k, pivots=9).collect()]
        assert len(got) == len(set(got)) and set(got) == slow_top(rows, k)


def test_rows_are_copied_only_where_they_can_matter(spark, monkeypatch):
    """Of 16 well-parted clusters, a row goes to one bundle of query groups or few, and no task holds more than its share."""
    monkeypatch.setattr(knn, "TASK_BYTES", 100 * 8 * 16)
    rng = np.random.default_rng(6)
    middle = np.eye(16) * 4
    rows = [(i, [float(x) for x in middle[i % 16] + rng.normal(0, 0.05, 16)]) for i in range(16, 8016)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    visits, copies, size = knn.deal(table, F.col("vec_id") % 5 == 0, pivots=64)
    bundles = visits.select("bundle").distinct().count()
    met = copies.groupBy("bundle", "block", "part").count().toPandas()
    asked = visits.groupBy("bundle", "block", "part").count().toPandas()
    blocks = met.groupby("bundle")["block"].nunique().sum()
    assert size == 16 and bundles >= 8
    assert met["count"].sum() < 0.25 * len(rows) * blocks
    assert met["count"].max() <= 130 and asked["count"].max() <= 140
    got = {tuple(r) for r in knn.top_k(table, F.col("vec_id") % 400 == 0, k=3, pivots=64).collect()}
    m = {k: np.floor(256 * np.array(v)) for k, v in rows}
    names = np.array(list(m))
    every = np.array([m[k] for k in names])
    want = set()
    for q in names[names % 400 == 0]:
        score = every @ m[q]
        order = [i for i in np.lexsort((names, -score)) if names[i] != q][:3]
        want |= {(int(q), n + 1, int(names[i]), int(score[i])) for n, i in enumerate(order)}
    assert got == want


def test_a_key_of_a_third_of_the_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(knn, "TASK_BYTES", 100 * 8 * 3)
    rng = np.random.default_rng(7)
    rows = [(7 if i % 3 else i, [float(x) for x in rng.normal(0, 1, 3)]) for i in range(900)] + [(50, [1.0, 2.0, 3.0])] * 300
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    visits, copies, _ = knn.deal(table, F.col("vec_id") % 50 == 0)
    met = copies.groupBy("bundle", "block", "part").count().toPandas()
    assert met["count"].max() <= 130
    assert visits.where("vec_id = 50").select("v").distinct().count() == visits.where("vec_id = 50 and part = 0").count()
    assert {tuple(r) for r in knn.top_k(table, F.col("vec_id") % 50 == 0).collect()} == slow_top(rows, 5)


def test_top_k_of_few_and_huge(spark):
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 50 == 0
    assert {tuple(r) for r in knn.top_k(few, asks).collect()} == {(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)}
    assert knn.top_k(few.where("vec_id = 0"), asks).count() == 0 and knn.top_k(few.where("false"), asks).count() == 0
    huge = spark.createDataFrame([(0, [1e12, 1.0]), (1, [3.0, 1.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in knn.top_k(huge, asks).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 256 * 10**12 * 768 + 256 * 512), (0, 2, 1, 256 * 10**12 * 768 + 256 * 256)]
