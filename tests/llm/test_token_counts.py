"""Token counts against the tokenizers library itself."""

import numpy as np
import public_tokenizers
import pytest
import time
from collections import Counter
from hypothesis import given, settings, strategies as st

from tracesieve.llm import token_counts
from tracesieve.llm.queries import QUERIES
from tracesieve.llm.token_counts import TokenCounter

PATH = public_tokenizers.path(token_counts.VOCABULARY)
COUNTER = TokenCounter(PATH)


def library(texts):
    return [len(e.ids) for e in COUNTER.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


HARD = [
    "it's <|endoftext|> a", "<|endoftext|>", "<|endoftext|><|endoftext|> x<|endoftext|>\n\n", "<|endoftext", "a  b   c\n\n\nd \n e\t\t f", "\x1c a\x85b\xa0c\tq\r\n  d", "  ", "\n", "", None,
    "aaaaaaaa aaaaaaa aaaaaa", "========== ----", "日本語 한국어 🙂🙂 a🙂b", "　 　x   y᠎ z​ w", "'''s!'s he'll I'VE 'S", "12345 ½²Ⅷ٣", "x" * 5000, " " * 3000 + "y",
    "é é ́x", "\x00\x01﻿�\U0010ffff", "the " * 1000,
]


def test_hard_texts():
    assert COUNTER.count(HARD) == library(HARD)


def test_every_code_point_between_spaces_and_letters():
    points = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000]
    for frame in ("a {} b", "1{}2", " {}  {}x"):
        texts = [frame.replace("{}", c) for c in points]
        assert COUNTER.count(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abestT' \n\t\r=-.1234é日🙂\x85\xa0　 \x1c<|>"), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    assert COUNTER.count(texts) == library(texts)


def long_words():
    rng = np.random.default_rng(3)
    letters = list("etaoinshrdluabcE")
    return ["".join(rng.choice(letters, 30_000)), "a" * 20_001, "ab" * 9_000, "=" * 7_777, "".join(rng.choice(list("0123456789"), 10_000)), "日" * 4_000, "aab" * 5_000]


def test_long_words_are_merged_along_their_ranks():
    assert COUNTER.count(long_words()) == library(long_words())


def test_both_ways_of_merging_agree(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aabcteh'="), n)) for n in range(1, 200)] + ["a" * n for n in range(1, 60)]
    want = COUNTER.survivors(words).tolist()
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert COUNTER.survivors(words).tolist() == want
    monkeypatch.setattr(token_counts, "LONG", 100)
    monkeypatch.setattr(token_counts, "SYMBOLS", 50)
    assert COUNTER.survivors(words).tolist() == want


def test_a_million_letters_without_a_space():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    start = time.time()
    got = COUNTER.count([text])
    assert time.time() - start < 60 and got == library([text])


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    own, texts = TokenCounter(PATH), ["one two three four", "five six, seven one two", "one eight nine two"]
    for _ in range(2):
        assert own.count(texts) == library(texts) and [own.count([t])[0] for t in texts] == library(texts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def check(got, rows):
    want = Counter((k, len((t or "").encode()), n, n > 512) for (k, t), n in zip(rows, library([t for _, t in rows])))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_whole_documents_with_odd_rows(documents, rows):
    check(token_counts.token_counts(documents), rows)


def test_slices_change_nothing(documents, rows, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 1000)
    check(token_counts.token_counts(documents.limit(60).cache()), [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()])


def test_empty_table(documents):
    assert token_counts.token_counts(documents.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_token_counts"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    check(got, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
