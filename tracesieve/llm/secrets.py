"""Secret scan: single secrets by pattern, and credentials whose parts are linked when they stand near each other."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracesieve.llm.batches import text_batches


#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
BASE = 3
#: A scope: code points between the nearest ends of two parts of one credential.
SCOPE = 200

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Weak parts, which tell nothing on their own: a client's or user's name, a random-looking word, the place that they open.
_IDENTIFIER = re.compile(r"""\b(?:client|account|user|access|key)[_-]?(?:id|name)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{6,})""", re.IGNORECASE | re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z/+_=-]*[0-9])(?=[0-9A-Z/+_=-]*[a-z])(?=[0-9a-z/+_=-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"""\b(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{4,}|\b(?:endpoint|host)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::\d+)?)""", re.IGNORECASE | re.ASCII)
_SIGN = re.compile(r"[:=]")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans ``(start, end, kind)`` of the base kinds: leftmost, non-overlapping within a kind, long enough."""
    found = [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    if _SIGN.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


class Near:
    """Which of some spans lie within ``scope`` of an interval: an interval join by bisection over their starts."""

    def __init__(self, spans: list[Span], scope: int):
        self.spans, self.scope = sorted(spans), scope
        self.starts = [s[0] for s in self.spans]
        self.reach, most = [], -1
        for s in self.spans:
            most = max(most, s[1])
            self.reach.append(most)

    def any(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end + self.scope + 1)
        return bool(i) and self.reach[i - 1] >= start - self.scope

    def around(self, start: int, end: int) -> bool:
        """Whether one of the spans contains the whole interval."""
        i = bisect_right(self.starts, start)
        return bool(i) and self.reach[i - 1] >= end


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak parts of credentials whose complementary parts co-occur in their scope.

    Identifiers (and base ``access`` spans), keys (and base ``assign`` and ``hex`` spans) and endpoints are joined by
    interval: an identifier is reported if a key is in its scope, a key if an identifier or an endpoint is, an endpoint if both an
    identifier and a key are.  A weak part that lies wholly inside one span of the base is that span, and is not reported again; one that
    reaches beyond it is a part of its own, as is the span.
    """
    if not _SIGN.search(text) and not any(k == 1 for *_, k in base):
        return []  # without an assignment, an address or an access span there is nothing to complement a key
    kinds = [[], [], [], [(m.start(1), m.end(1), 3) for m in _IDENTIFIER.finditer(text)], [(m.start(), m.end(), 4) for m in _KEY.finditer(text)], [(m.start(), m.end(), 5) for m in _ENDPOINT.finditer(text)]]
    for s in base:
        kinds[s[2]].append(s)
    held = Near(base, 0)
    weak = [[s for s in kinds[k] if not held.around(s[0], s[1])] for k in (3, 4, 5)]
    identifiers, keys, endpoints = (Near(x, scope) for x in (weak[0] + kinds[1], weak[1] + kinds[0] + kinds[2], weak[2]))
    found = [s for s in weak[0] if keys.any(*s[:2])]
    found += [s for s in weak[1] if identifiers.any(*s[:2]) or endpoints.any(*s[:2])]
    found += [s for s in weak[2] if identifiers.any(*s[:2]) and keys.any(*s[:2])]
    return found


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then kind, comma-joined; code points, the end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` and ``n_linked``.

    Whole texts are scanned in one pass without a shuffle; a null or empty text has no spans.  Repeated rows and null keys stay, and
    only ``doc_id`` and ``text`` are read.
    """
    text_batches(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = linked_spans(text, base, scope)
                counts = [sum(s[2] == k for s in base) for k in range(BASE)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[{}]") -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by its kind, and ``n_chars``, where there is one, counted anew.

    Overlapping spans are replaced together, by the kind of the first.  Rows without spans, null texts and all other columns are unchanged.
    """
    text_batches(docs)
    at, sized = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            sizes = columns[sized].to_pylist() if sized is not None else [None] * len(texts)
            for row, text in enumerate(texts):
                base = base_spans(text or "")
                spans = sorted(base + linked_spans(text or "", base, scope), key=lambda s: (s[0], s[2], s[1]))
                if spans:
                    out, done = [], 0
                    for a, b, k in spans:
                        if a >= done:
                            out += [text[done:a], mark.format(KINDS[k])]
                        done = max(done, b)
                    texts[row] = "".join(out) + text[done:]
                    sizes[row] = len(texts[row])
            columns[at] = pa.array(texts, columns[at].type)
            if sized is not None:
                columns[sized] = pa.array(sizes, columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(hide, docs.schema)
