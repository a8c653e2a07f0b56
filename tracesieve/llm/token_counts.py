"""Token counts of whole texts for a byte-level BPE vocabulary, by merging ragged arrays of symbols rank by rank.

Texts are cut where white space begins, a cut no pre-token spans, and every distinct piece is counted once by a worker.  New pieces become
pre-tokens by the library's own rules; the symbols of all new pre-tokens then stand in one array.  In every round each sequence's pair of
the lowest rank is merged, wherever it stands in it and in all sequences at once, until no pair is left; the count is of what survives.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracesieve.llm.batches import text_batches

#: Vocabulary file of ``public_tokenizers``; every function takes another path.
VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by one worker process; beyond it the memory is emptied and refilled.  It changes no result.
MEMORY = 400_000
#: Symbols merged at a time.
SYMBOLS = 1 << 20
#: Sequences of more symbols are merged one by one, along lists of where each rank stands.
LONG = 2048
#: Tokens above which a text is over the limit.
LIMIT = 512

# The code points with the property White_Space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_NEVER = np.int32(2**31 - 1)

_counters: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """How many tokens the library gives for a text, by a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model, added = stored["model"], stored["added_tokens"]
        cutter = stored["pre_tokenizer"] or {}
        odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"] or stored["normalizer"] or odd or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocabulary = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = 1 + max(vocabulary.values())
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.symbols = np.full(0x200, -1, np.int64)  # the byte-level alphabet lies below U+0200
        for text, number in vocabulary.items():
            if len(text) == 1:
                self.symbols[ord(text)] = number
        self.pieces: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, ``_NEVER`` of those that do not merge."""
        sought = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        return np.where(self.keys[at] == sought, self.ranks[at], _NEVER)

    def survivors(self, tokens: list[str]) -> np.ndarray:
        """How many symbols of each pre-token, given in the byte-level alphabet, no merge takes away."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.symbols[np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(lengths)
        counts = np.zeros(len(tokens), np.int64)
        long = np.flatnonzero(lengths > LONG)
        for i in long.tolist():
            counts[i] = self._along(symbols[ends[i] - lengths[i] : ends[i]])
        which = np.flatnonzero(lengths <= LONG)
        at = 0
        while at < len(which):
            sizes = np.cumsum(lengths[which[at:]])
            to = at + max(1, int(np.searchsorted(sizes, SYMBOLS, side="right")))
            own = which[at:to]
            held = np.concatenate([symbols[ends[i] - lengths[i] : ends[i]] for i in own]) if len(long) else symbols[ends[own[0]] - lengths[own[0]] : ends[own[-1]]]
            counts[own] = self._together(held, lengths[own])
            at = to
        return counts

    def _together(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rounds over sequences that stand in a row: ``lengths`` says where each ends."""
        out, live = lengths.copy(), np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        lengths = lengths[live]
        while len(live):
            ends = np.cumsum(lengths)
            rank = np.full(len(symbols), _NEVER, np.int32)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[ends - 1] = _NEVER  # the last of a sequence has no neighbour
            least = np.minimum.reduceat(rank, ends - lengths)
            going = least < _NEVER
            hit = rank == np.repeat(np.where(going, least, -1), lengths)
            # In a run of equal symbols pairs overlap: every second one merges, from the left.
            begins = hit.copy()
            begins[1:] &= ~hit[:-1]
            places = np.flatnonzero(hit)
            starts = np.flatnonzero(begins)
            merged = places[(places - starts[np.searchsorted(starts, places, side="right") - 1]) % 2 == 0]
            symbols[merged] = self.made[rank[merged]]
            keep = np.repeat(going, lengths)
            keep[merged + 1] = False
            taken = np.bincount(np.searchsorted(ends, merged, side="right"), minlength=len(live))
            lengths = lengths - taken
            out[live] = lengths
            symbols = symbols[keep]
            live, lengths = live[going], lengths[going]
        return out

    def _along(self, symbols: np.ndarray) -> int:
        """The same rounds over one long sequence: neighbours are linked, and a round visits the places of its rank only."""
        n = len(symbols)
        symbols = np.append(symbols, 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        rank = np.full(n + 1, _NEVER, np.int32)
        rank[: n - 1] = self._rank(symbols[: n - 1], symbols[1:n])
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < _NEVER]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(part)

        note(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Overlapping pairs follow each other in the list of neighbours: every second one merges, from the left.
            begins = np.concatenate(([True], after[at[:-1]] != at[1:]))
            run = np.flatnonzero(begins)
            nth = np.arange(len(at)) - run[np.cumsum(begins) - 1]
            at = at[nth % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            rank[gone] = _NEVER
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            left = before[at]
            touched = np.unique(np.concatenate((at, left[left >= 0])))
            last = after[touched] >= n
            rank[touched] = np.where(last, _NEVER, self._rank(symbols[touched], symbols[np.minimum(after[touched], n)]))
            note(touched)
        return int(alive[:n].sum())

    def _learn(self, new: list[str]) -> None:
        """Count the tokens of pieces not seen before."""
        if len(self.pieces) + len(new) > MEMORY:
            self.pieces = {}
        cut = self.library.pre_tokenizer.pre_tokenize_str
        index: dict[str, int] = {}
        owners, tokens = [], []
        for i, piece in enumerate(new):
            for token, _ in cut(piece):
                owners.append(i)
                tokens.append(index.setdefault(token, len(index)))
        each = self.survivors(list(index)) if index else np.zeros(0, np.int64)
        totals = np.bincount(owners, weights=each[tokens], minlength=len(new)).astype(np.int64) if owners else np.zeros(len(new), np.int64)
        self.pieces.update(zip(new, totals.tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null one has none."""
        cut, special = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.special and text and self.special.search(text):
                parts = self.special.split(text)  # a special token ends what stands before it
                special[i] = len(parts) - 1
                cut.append([p for part in parts for p in _CUT.findall(part)])
            else:
                cut.append(_CUT.findall(text) if text else [])
        new = list({p for own in cut for p in own if p not in self.pieces})
        extra: dict[str, int] = {}
        if new:
            known = self.pieces
            self._learn(new)
            if self.pieces is not known:  # the memory was emptied: what this batch still needs is in the old one
                extra = known
        have = self.pieces
        look = have.__getitem__ if not extra else lambda p: have[p] if p in have else extra[p]
        return [sum(map(look, own)) + int(s) for own, s in zip(cut, special)]


def counter(path: str) -> TokenCounter:
    """One counter for each vocabulary and worker process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Code points of text counted at a time.
SLICE = 4 << 20


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` as the tokenizers library counts them, and whether they are over ``limit``.

    No special tokens are added; their strings in a text are special tokens, as by the library's default.  Whole texts are counted in one
    map without a shuffle: a null or empty text has none, a very long one is cut like any other.  Null keys and repeated rows stay, an
    empty table gives no rows, other columns are not read.
    """
    text_batches(docs)
    place = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(_vocabulary(place))
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            counts: list[int] = []
            while len(counts) < len(texts):
                at = len(counts)
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right")))
                counts += own.count(texts.slice(at, to - at).to_pylist())
            n = pa.array(counts, pa.int64())
            sizes_of = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes_of, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
