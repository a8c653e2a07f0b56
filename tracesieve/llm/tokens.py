"""Token ids of whole texts, exactly those of the tokenizers library, with every distinct word encoded once per worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vocabulary file of ``public_tokenizers``; every function takes another path.
VOCABULARY = "word_bpe_49k.json"
#: Words that are new before a worker process forgets those it has not met since as many before: a query's own, and in a pipeline, whose
#: workers are shared by stages.  Parts of words are counted likewise.  They change no result.
MEMORY = 200_000
SMALL_MEMORY = 60_000
PARTS = 200_000
#: Bytes of text encoded at a time.
SLICE = 6 << 20
#: Parts of words that are new, encoded in one call of the library.
RUN = 256

# Letters and numbers below U+0100 after lower-casing, and the pre-tokenizer's contractions.
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_ODD = r"[^!-~¡-ÿ]|<\|"

_encoders: dict[tuple[str, int], "WordEncoder"] = {}


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the place of the default vocabulary file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts``, in a row."""
    where = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    where += np.arange(len(where))
    return ids[where]


class Generation:
    """Distinct keys and the ids of each, as columns."""

    def __init__(self):
        self.names = pa.array([], pa.large_string())
        self.ids, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def keys(self) -> set[str]:
        return set(self.names.to_pylist())

    def find(self, names: pa.Array) -> np.ndarray:
        """The places of keys, -1 where there is none."""
        return pc.index_in(names, self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of new keys, whose ids are in a row."""
        first = len(self)
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, ids))
        return np.arange(first, len(self))


class Recent:
    """Ids of keys in two generations: what is asked for moves to the young one, and a full young one replaces the old one."""

    def __init__(self, size: int):
        self.size = size
        self.young, self.old = Generation(), Generation()

    def find(self, names: pa.Array) -> np.ndarray:
        """The places of distinct keys in the young generation, -1 where neither has them."""
        at = self.young.find(names)
        lost = np.flatnonzero(at < 0)
        if len(lost) and len(self.old):
            again = self.old.find(names.take(pa.array(lost)))
            lost, again = lost[again >= 0], again[again >= 0]
            lengths = self.old.lengths[again]
            at[lost] = self.young.add(names.take(pa.array(lost)), gather(self.old.ids, self.old.starts[again], lengths), lengths)
        return at

    def turn(self) -> None:
        """Forget, if the young generation is full."""
        if len(self.young) > self.size:
            self.young, self.old = Generation(), self.young


class WordEncoder:
    """Ids of texts for a byte-level vocabulary that lower-cases and drops white space.

    No token spans white space, so the ids of a text are those of its words in a row.
    Cuts are made at spaces and line feeds only; all else in a word is left to the library, but for
    plain Latin words, which are cut as its pre-tokenizer cuts them because the parts repeat more.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.pieces = Recent(memory), Recent(PARTS)
        # The byte-level alphabet: bytes that print stand for themselves, the others are numbered from 256.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = {b: chr(256 + n) for n, b in enumerate(hidden) if b != 32}
        # The model by itself, for parts of words in that alphabet, with spaces between them.
        self.cut = Tokenizer(self.tokenizer.model)
        self.cut.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of words in a row, and how many each has; many parts make one call."""
        ids, lengths = [], []
        for at in range(0, len(pieces), RUN):
            own = pieces[at : at + RUN]
            text = " ".join(own)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.alphabet)
            found = self.cut.encode(text, add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Keep the ids of distinct words, and return the words' places."""
        is_odd = pc.match_substring_regex(new, _ODD)
        odd, plain = new.filter(is_odd), new.filter(pc.invert(is_odd))
        low = pc.utf8_lower(plain)
        whole = pc.utf8_is_alpha(low)
        parts = [_PIECE.findall(w) for w in low.filter(pc.invert(whole)).to_pylist()]
        cut = pa.array(list(chain.from_iterable(parts)), pa.large_string())
        coded = pa.concat_arrays([low.filter(whole), cut]).dictionary_encode()
        at = self.pieces.find(coded.dictionary)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            names = coded.dictionary.take(pa.array(lost))
            lost = lost[np.argsort(~pc.string_is_ascii(names).to_numpy(zero_copy_only=False), kind="stable")]
            names = coded.dictionary.take(pa.array(lost))
            at[lost] = self.pieces.young.add(names, *self._encode_pieces(names.to_pylist()))
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.pieces.young.lengths[at]
        ids = gather(self.pieces.young.ids, self.pieces.young.starts[at], lengths)
        counts = np.concatenate((np.ones(len(at) - len(cut), np.int64), np.fromiter(map(len, parts), np.int64, len(parts))))
        sums = np.concatenate(([0], np.cumsum(lengths)))
        lengths = np.diff(sums[np.concatenate(([0], np.cumsum(counts)))])
        rest = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(odd.to_pylist(), add_special_tokens=False)]
        names = pa.concat_arrays([plain.filter(whole), plain.filter(pc.invert(whole)), odd])
        found = self.words.young.add(names, np.concatenate((ids, *rest)), np.concatenate((lengths, np.fromiter(map(len, rest), np.int64, len(rest)))))
        # The words were taken apart in this order.
        is_odd = is_odd.to_numpy(zero_copy_only=False)
        usual, alone = np.flatnonzero(~is_odd), whole.to_numpy(zero_copy_only=False)
        places = np.empty(len(new), np.int64)
        places[np.concatenate((usual[alone], usual[~alone], np.flatnonzero(is_odd)))] = found
        return places

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts in order: their ids in a row, and how many each has.  A null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            yield self._slice(texts.slice(at, to - at))
            at = to

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        self.words.turn()
        self.pieces.turn()
        at = self.words.find(coded.dictionary)
        lost = np.flatnonzero(at < 0)
        if len(lost):
            at[lost] = self._learn(coded.dictionary.take(pa.array(lost)))
        known, place = self.words.young, at[index]
        counts = known.lengths[place]
        ends = np.concatenate(([0], np.cumsum(counts)))
        cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        return gather(known.ids, known.starts[place], counts), np.diff(ends[cuts])


def encoder(path: str, memory: int | None = None) -> WordEncoder:
    """One encoder for each vocabulary, memory and worker process."""
    key = (path, memory or MEMORY)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
