"""Secret and licence scans, the quality model, and the pipeline's stages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tracesieve.llm import batches, licenses, quality, secrets

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    """The base spans as they are stated: match, then drop what is too short."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[0], s[2]))


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "ſecret", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EFGH56", "deadbeef01234567", "x-/+_.=", "é", "\n", "abcdefghijkl"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_spans(text)


KEY = "aB3" * 8


@pytest.mark.parametrize(
    "text, kinds",
    [
        (f"client_id: svc-reader {KEY}", ["identifier", "key"]),
        (f"only a word {KEY} here", []),
        ("client_id: svc-reader and nothing else", []),
        (f"https://api.example.com/v1 {KEY}", ["key"]),
        (f"user = alice_01 key {KEY} at https://db.example.com:5432", ["identifier", "key", "endpoint"]),
        (f"client_id: svc-reader{' .' * 150} {KEY}", []),
        (f"AKIA{'Z9' * 8} {KEY}", ["key"]),
        ("password = abcdefghijkl12 user_name: someone", ["identifier"]),
        ("", []),
    ],
)
def test_weak_parts_need_their_complement(text, kinds):
    found = secrets.linked_spans(text, secrets.base_spans(text))
    assert [secrets.KINDS[k] for *_, k in sorted(found)] == kinds


@pytest.mark.parametrize("name, key", [(64, 128), (65, 129), (300, 152), (20, 700)])
def test_long_weak_parts(spark, name, key):
    name, key = "n" * name, ("aB3" * key)[:key]
    text = f"client_id: {name} then {key}== end"
    assert secrets.linked_spans(text, secrets.base_spans(text)) == [(11, 11 + len(name), 3), (17 + len(name), 19 + len(name) + len(key), 4)]
    assert secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"] == "client_id: [identifier] then [key] end"


HEX = "0123456789abcdef"


@pytest.mark.parametrize(
    "text, kinds, hidden",
    [
        ("user_id: someone at https://host/v1?token=abcdefghijkl1234 end", ["identifier", "endpoint"], "user_id: [identifier] at [endpoint] end"),
        (f"https://host/v1?token=abcdefghijkl1234 and {KEY}", ["key"], "https://host/v1?[assign] and [key]"),
        (f"client_id: svc-reader Zx{HEX}Zy9{KEY} end", ["identifier", "key"], "client_id: [identifier] [key] end"),
        (f"secret={KEY} user_id: someone", ["identifier"], "[assign] user_id: [identifier]"),
    ],
)
def test_weak_parts_that_reach_beyond_base_spans(spark, text, kinds, hidden):
    found = secrets.linked_spans(text, secrets.base_spans(text))
    assert [secrets.KINDS[k] for *_, k in sorted(found)] == kinds
    assert secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"] == hidden


def test_near_is_an_interval_join():
    rng = np.random.default_rng(1)
    for _ in range(200):
        spans = [(int(a), int(a + n), 0) for a, n in zip(rng.integers(0, 80, 5), rng.integers(1, 30, 5))]
        a, scope = int(rng.integers(0, 100)), int(rng.integers(0, 10))
        assert secrets.Near(spans, scope).any(a, a + 3) == any(s <= a + 3 + scope and e >= a - scope for s, e, _ in spans)


def test_scan_and_redact(documents, rows):
    got = secrets.scan(documents).collect()
    assert len(got) == len(rows)
    names = ("assign", "access", "hex")
    want = Counter()
    for key, text in rows:
        spans = plain_spans(text or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, b, k in spans)
        want[(key, *(sum(s[2] == k for s in spans) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    hidden = secrets.redact(documents)
    assert hidden.columns == documents.columns and hidden.dtypes == documents.dtypes
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in hidden.collect()]
    assert all(not plain_spans(t or "") for _, t, _ in texts) and Counter(k for k, *_ in texts) == Counter(k for k, _ in rows)
    assert Counter(t for _, t, _ in texts if t in {x for _, x in rows}) == Counter(t for _, t in rows if not plain_spans(t or "") and not secrets.linked_spans(t or "", []))
    changed = {t for _, t, n in texts} - {x for _, x in rows}
    assert all(n == len(t) for _, t, n in texts if t in changed)
    assert secrets.scan(documents.where("false")).count() == 0


def slow_licences(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    every = licenses.TEMPLATES + licenses.MORE
    places = [[s for s in range(-len(t.words), len(words)) if all(s + k >= 0 and tuple(words[s + k : s + k + len(own)]) == own for k, own in t.keys)] for t in every]
    base = [s for p in places[:4] for s in p]
    share = [sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(t.words)) / len(t.words) for t, p in zip(every, places) for s in p]
    label = lambda n: ",".join(sorted({t.label for t, p in zip(every[:n], places) if p}))
    return len(words), len(base), min(base, default=None), max(base, default=None), label(4), label(len(every)), max(share, default=0.0)


LICENCES = [
    "Mit License, MIT license! mit-license",
    "cc by cc by cc-by-nc",
    "GNU General Public License, the gnu general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "x granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "permission is hereby granted free of charge to some other person getting the copy of this software and associated documentation files",
    "mozilla public license",
    "source mozilla public license",
    "ApacheİLicense apache lıcense apache license",
    "gnu gnu general public license license",
    "",
    None,
    "Kelvin K mit license",
]


def test_licences(spark, documents, rows):
    own = [(i, t) for i, t in enumerate(LICENCES)]
    table = spark.createDataFrame(own, "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("p0", F.lit(0))
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for data, want in ((table, own), (documents, rows)):
        got = Counter((r["doc_id"], *(r[c] for c in columns)) for r in licenses.scan_licenses(data).collect())
        assert got == Counter((k, *slow_licences(t)) for k, t in want)
    assert licenses.scan_licenses(table.where("false")).count() == 0


def test_edited_licence_texts(spark):
    """Full texts with one word in fifteen changed: found as long as the mandatory phrases stand, and scored by what is left."""
    rng = np.random.default_rng(3)
    long = [t for t in licenses.MORE if len(t.words) >= 30]
    rows = []
    for n, t in enumerate(long):
        for copy in range(30):
            words = [w if rng.random() > 1 / 15 else "changed" for w in t.words]
            rows.append((n * 100 + copy, " ".join(["before"] * int(rng.integers(0, 50)) + words + ["behind"] * int(rng.integers(0, 9)))))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {k: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for k, r in got.items()} == {k: slow_licences(x) for k, x in rows}
    recall = np.mean([long[k // 100].label in r["labels"].split(",") for k, r in got.items()])
    assert recall > 0.4  # a phrase of ten words is left whole with a chance of 0.93 ** 10, which is 0.5


def test_the_plan_does_not_follow_the_templates(spark, documents):
    many = licenses.MORE + tuple(licenses.Template.of(f"own-{i}", f"alpha beta{i} gamma{i % 7} delta licence", f"beta{i} gamma{i % 7}") for i in range(300))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("lambda")
    wide = licenses.scan_licenses(documents, many)
    assert plan(wide) == plan(licenses.scan_licenses(documents))
    extra = spark.createDataFrame([(1, "Alpha beta17 gamma3, delta licence"), (2, "beta299 gamma5 x"), (3, "beta299 gamma4")], "doc_id long, text string")
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(extra, many).collect()} == {1: ("own-17", 1.0), 2: ("own-299", 0.4), 3: ("", 0.0)}


def test_pairs_are_summed_in_linear_time():
    rng = np.random.default_rng(0)
    rows = quality.features(pa.array(["one two two three", "", None, "a\nb\nb"]), np.array([3.0, np.nan, 0.0, -1.0]))
    model = quality.FactorisationMachine(0.3, rng.normal(size=quality._SIZE), rng.normal(size=(quality._SIZE, 4)))
    for r, got in enumerate(model.margins(rows)):
        at, x = rows.at[rows.cuts[r] : rows.cuts[r + 1]], rows.values[rows.cuts[r] : rows.cuts[r + 1]]
        pairs = sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert np.isclose(got, 0.3 + model.weights[at] @ x + pairs)


def test_features_do_not_depend_on_the_slice(rows):
    texts, stated = pa.array([t for _, t in rows[:60]], pa.string()), np.zeros(60)
    whole, parts = quality.features(texts, stated), quality.joined([quality.features(texts.slice(i, 7), stated[i : i + 7]) for i in range(0, 60, 7)])
    model = quality.FactorisationMachine(0.0, np.arange(quality._SIZE) / 1e4, np.ones((quality._SIZE, 4)))
    assert np.allclose(model.scores(whole), model.scores(parts))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    told = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).select("score", "quality").toPandas()
    assert len(told) > 50 and ((told["score"] >= 0.7) == (told["quality"] == 1)).mean() > 0.95
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), other)
    assert np.array_equal(model.weights, again.weights)  # neither held-out labels nor lang and source are inputs


def test_quality_fit_is_bounded_in_bytes(spark):
    """The fit takes the first rows by the hash of their key whose features are within the bound; with none it knows nothing."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = quality.train(docs, labels, sample=20)
    read = quality._read(docs).join(labels.where(~quality.held_out()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).toPandas()
    sizes = [8 * len(quality.features(pa.array([t]), np.array([n])).at) for t, n in zip(read["text"], read["stated"])]
    whole = quality.train(docs, labels, most_bytes=sum(sizes))
    assert np.array_equal(few.weights, whole.weights) and few.weights.any()
    assert not np.array_equal(few.weights, quality.train(docs, labels, most_bytes=sum(sizes) - 1).weights)
    nothing = quality.train(docs, labels, most_bytes=0)
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_batches_are_bounded_in_bytes(spark):
    """Long texts come in small batches; the caller's number of rows and own bound stay."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, rows = spark.conf.get(setting), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    try:
        spark.conf.unset(setting)
        batches.text_batches(table)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows

        def sizes(parts):
            for part in parts:
                yield pa.RecordBatch.from_arrays([pa.array([part.nbytes])], names=["n"])

        assert max(r["n"] for r in table.mapInArrow(sizes, "n long").collect()) < 2 * batches.BYTES
        spark.conf.set(setting, "123456789b")
        batches.text_batches(table)
        assert spark.conf.get(setting) == "123456789b"
    finally:
        spark.conf.set(setting, before)


def test_quality_of_odd_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (4, 7, 0), (9001, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        got = quality.score(documents, quality.train(documents, some)).collect()
        assert len(got) == documents.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.keep_good(documents, labels, threshold=0.0)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert quality.score(documents.where("false"), quality.train(documents.where("false"), labels)).count() == 0
    assert quality.score(documents.drop("n_chars"), quality.train(documents.drop("n_chars"), labels)).count() == documents.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, sf).cache()
        assert new.columns == columns and new.dtypes == docs.dtypes and 0 < new.count() <= kept.count(), name
        kept = new
    want = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == want
    bench = [t for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    texts = [t for (t,) in kept.select("text").collect()]
    assert not any(b in t for b in bench for t in texts) and len(set(texts)) == len(texts)


def test_stages_of_no_documents(spark):
    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
