"""Tokens, packing and token files against the tokenizers library itself."""

import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tracesieve.llm import packing, token_files
from tracesieve.llm.tokens import WordEncoder, vocabulary_path

ENCODER = WordEncoder(vocabulary_path())


def ids_of(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    out = []
    for ids, counts in ENCODER.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


HARD = ["it's <|endoftext|> a", "x<|startoftext|>y he'll 'S 'lla", "\x1c a\x85b\xa0c\tq\r\n  d", "ÀÉß İstanbul Σας ²³¼ 12 3x", "é é ́x", "日本語 한국어 🙂🙂 a🙂b", "", "  ", "\n", "'''s!'s", "a_b_c", "naïve×÷ÿŸ", "Kelvin ſ", None]


def test_words_encode_as_the_library_does():
    assert encoded(HARD) == [ids_of(t) for t in HARD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sStT re\n\t<|>é́ÀßİΣ1²½日🙂\x85\xa0\x1c!&"), max_size=30), min_size=1, max_size=5))
def test_any_text_encodes_as_the_library_does(texts):
    assert encoded(texts) == [ids_of(t) for t in texts]


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr("tracesieve.llm.tokens.PARTS", 3)
    own, texts = WordEncoder(vocabulary_path(), 3), ["one two three four", "five six, seven", "one eight nine", "", "one  two", "\x00 one"]
    got = [ids.tolist() for t in texts for ids, _ in own.encode(pa.array([t]))]
    assert got == [ids_of(t) for t in texts]


def check_layout(layout, window):
    for _, own in layout.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= window


def test_pack(documents, rows):
    got = packing.pack(documents, keep_ids=True).toPandas()
    check_layout(got, packing.WINDOW)
    want = Counter()
    for key, text in rows:
        own = np.array([*ids_of(text), 2], "<u4")
        for s in range(0, len(own), 4096):
            part = own[s : s + 4096]
            want[(key, s, len(part), zlib.crc32(part.tobytes()), len(own))] += 1
    key = [None if np.isnan(x) else int(x) for x in got["doc_id"].astype(float)]
    assert Counter(zip(key, got["start"], got["length"], got["ids_crc32"], got["doc_tokens"])) == want
    assert all(len(i) == 4 * n and zlib.crc32(i) == c for i, n, c in zip(got["ids"], got["length"], got["ids_crc32"]))


def test_sequences_are_padded(documents):
    made = packing.sequences(packing.pack(documents.limit(50), keep_ids=True)).toPandas()
    for ids, n in zip(made["ids"], made["length"]):
        assert len(ids) // 4 == (n if n & (n - 1) == 0 else 4096) and not np.frombuffer(ids, "<u4")[n:].any()


def test_pack_without_rows(documents):
    assert packing.pack(documents.where("false")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = np.array(lengths, np.int64)
    names, offsets = packing.best_fit(lengths, 16)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [c for c, _ in free if c >= lengths[i]]
        want[i] = min(fits) - lengths[i] if fits else 16 - lengths[i]
        own = names[i]
        free = [(c, n) for c, n in free if n != own] + [(want[i], own)]
        assert offsets[i] == 16 - want[i] - lengths[i]


@pytest.mark.parametrize("values", [[], [0], [1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], list(range(1000))])
def test_ranks_round_trip(values):
    control, data = token_files.encode_ranks(np.array(values, "<u4"))
    assert token_files.decode_ranks(control, data, len(values)).tolist() == values


def test_token_files(spark, documents, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 20_000)
    path = token_files.write_token_files(documents, str(tmp_path / "files"))
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    order = sorted((k is not None, k or 0) for k, _ in rows)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == order
    want = Counter((k, zlib.crc32(np.array([*ids_of(t), 1], "<u4").tobytes()), len(ids_of(t)) + 1) for k, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_no_token_files(spark, documents):
    assert token_files.read_token_files(spark, token_files.write_token_files(documents.where("false"))).count() == 0


def test_words_met_lately_are_looked_up_without_a_call_each():
    words = [f"word{i}" for i in range(20_000)]
    tool = WordEncoder(vocabulary_path(), memory=10_000)
    text = pa.array([" ".join(words)])
    (first, _), = tool.encode(text)
    tool.words.turn()  # all are of the old generation now
    assert not tool.words.young and len(tool.words.old) == len(words)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        (again, _), = tool.encode(text)
    finally:
        sys.setprofile(None)
    assert (first == again).all() and len(calls) < 1000
    assert tool.words.young.keys() == set(words)


def test_new_words_are_encoded_many_in_a_call():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefgßéÀ"))
    words = list(dict.fromkeys("".join(w) for w in letters[rng.integers(0, 10, (12_000, 7))]))
    words[::7] = [f"{w}-{i}'s" for i, w in enumerate(words[::7])]
    words[::1000] = [f"{w}日\t{w}" for w in words[::1000]]
    tool, calls = WordEncoder(vocabulary_path()), []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        (ids, counts), = tool.encode(pa.array([" ".join(words), None, "abc\n" + words[3]]))
    finally:
        sys.setprofile(None)
    assert len(calls) < 1000
    want = [ids_of(t) for t in (" ".join(words), None, "abc\n" + words[3])]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
