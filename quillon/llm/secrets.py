"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them the text is lexed as source or configuration, once from left to right: before every
assignment sign stands the target name, after it the right-hand side, which is string literals joined by ``+``, bare values, or names of
constants assigned earlier in the same text, which are propagated. A literal is scored by how sensitive its target name is and by
how far it looks drawn at random; those that reach ``threshold`` and that no base span covers give ``pair`` spans.

A constant is kept as the places of its literals and the counts of its characters, never as joined text, and is written out at most once,
so time and memory grow with the text alone, also where it has no blank or where constants double from line to line.

Defined results: a null or empty text has no spans; each row stands alone, so repeated rows repeat their spans; texts of any length are read
whole; an empty table gives an empty result. Positions are code points of the whole text, ends exclusive. Output names in ``keep`` raise
ValueError; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "pair")
#: Parts of target names, with the weight each gives.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "bearer": 0.8, "key": 0.5, "salt": 0.4}
THRESHOLD = 0.6

#: A target name, what may close it, and the sign. Nothing is given back once read, so a long name is read once.
_TARGET = re.compile(r"""(?<![\w$.-])[0-9.-]*+([A-Za-z_$][\w$.-]*+)["'\])]*+[ \t]*+(?:=>|:=|[=:])""", re.A)
#: A quoted string, or a bare value with the padding of base64.
_LITERAL = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]++|\\.)*+)"|'((?:[^'\\\n]++|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9_$][\w$.+/@-]*+={0,2}+))""", re.A)
_PLUS = re.compile(r"[ \t]*+\+(?=[ \t]*+[\"'`A-Za-z_$])")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEXLUT = W._class([(0x30, 0x39), (0x61, 0x66)])


def base_spans(text: str, hexed: bool = True) -> list[tuple[int, int, str, int, str]]:
    """(start, end, kind, start of the value, name) of the base patterns."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign", m.start(2), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start(), "") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hexed:
        out += [(m.start(), m.end(), "hex", m.start(), "") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return out


class Value:
    """A literal, or several joined: places in the text and counts of characters."""

    __slots__ = ("_counts", "parts", "place", "text")

    def __init__(self, text: str, place: tuple[int, int] | None = None, parts: list[Value] | None = None):
        self.text, self.place, self.parts, self._counts = text, place, parts, None
        if parts:
            self._counts = sum((p.counts() for p in parts), Counter())

    def counts(self) -> Counter:
        if self._counts is None:
            self._counts = Counter(self.text[self.place[0] : self.place[1]])
        return self._counts

    def literals(self, seen: set[int] | None = None) -> Iterator[tuple[int, int]]:
        """Places in order; with ``seen`` those of values that are not in it yet."""
        todo = [self]
        while todo:
            v = todo.pop()
            if seen is not None:
                if id(v) in seen:
                    continue
                seen.add(id(v))
            if v.parts:
                todo += v.parts[::-1]
            else:
                yield v.place


def assignments(text: str, least: float = 0.0) -> Iterator[tuple[str, Value]]:
    """(target name, value) of every assignment to a name of at least this weight, constants propagated."""
    known: dict[str, Value | tuple[int, int]] = {}  # a single literal is its place until someone asks for it

    def value(found: str | tuple[int, int]) -> Value:
        if isinstance(found, tuple):
            return Value(text, found)
        if isinstance(known[found], tuple):
            known[found] = Value(text, known[found])
        return known[found]

    for sign in _TARGET.finditer(text):
        lit = _LITERAL.match(text, sign.end())
        if not lit:
            continue
        name, parts = sign[1], []
        while lit:
            group = lit.lastindex
            parts.append(lit[4] if group == 4 and lit[4] in known else lit.span(group))
            plus = _PLUS.match(text, lit.end())
            lit = plus and _LITERAL.match(text, plus.end())
        if len(parts) > 1:
            known[name] = Value(text, None, [value(x) for x in parts])
        elif isinstance(parts[0], str):
            known[name] = value(parts[0])
        else:
            known[name] = parts[0]
        if weight(name) >= least:
            yield name, value(name)


def pairs(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(target name, value, places of the literals that make it up) of every assignment, written out in full."""
    for name, value in assignments(text):
        places = list(value.literals())
        yield name, "".join(text[a:b] for a, b in places), places


@lru_cache(4096)
def weight(name: str) -> float:
    """Sensitivity of a target name, 0 to 1."""
    parts = [p.lower() for p in _PART.findall(name)]
    return max((SENSITIVE[p] for p in (*parts, *map("".join, zip(parts, parts[1:], strict=False))) if p in SENSITIVE), default=0.0)


def look(counts: Counter) -> float:
    """0 to 1: how far a value with these characters looks drawn at random."""
    size = counts.total()
    if size < 8 or any(c.isspace() for c in counts):
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in counts.values())
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "-" for c in counts}
    return min(1.0, bits / 3.0) * (1.0 if len(kinds) >= 2 else 0.5)


def scan(text: str | None, hexed: bool = True, threshold: float = THRESHOLD) -> list[dict]:
    """Spans sorted by start, then kind as listed."""
    if not text:
        return []
    out = base_spans(text, hexed)
    rows = [{"kind": k, "start": s, "end": e, "value_start": v, "name": n, "score": 1.0} for s, e, k, v, n in out]
    if "=" in text or ":" in text:
        starts = sorted(x[0] for x in out)
        reach = list(accumulate((e for _, e in sorted((x[0], x[1]) for x in out)), max))  # the furthest end of the spans so far
        written: set[int] = set()
        places: set[tuple[int, int]] = set()
        held: list[Value] = []  # keeps the ids in written from being used again
        looks: dict[int, float] = {}
        for name, value in assignments(text, threshold):
            if id(value) not in looks:
                held.append(value)
                looks[id(value)] = look(value.counts())
            got = weight(name) * looks[id(value)]
            if got < threshold:
                continue
            for s, e in value.literals(written):
                i = bisect_right(starts, s)
                if (s, e) not in places and e > s and not (i and reach[i - 1] >= e):
                    places.add((s, e))
                    rows.append({"kind": "pair", "start": s, "end": e, "value_start": s, "name": name, "score": got})
    return sorted(rows, key=lambda r: (r["start"], KINDS.index(r["kind"]), r["end"]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
SPANS_SQL = "array<struct<kind: string, start: bigint, end: bigint, value_start: bigint, name: string, score: double>>"


def _long_hex(column: pa.Array) -> np.ndarray:
    """Which texts hold a run of hexadecimal digits that is long enough."""
    data, bounds = W.raw(column)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _HEXLUT[data]
    flip = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = flip[::2], flip[1::2]
    # a run that crosses into the next text only makes a scan too many
    at = start[end - start >= LEAST["hex"]]
    ends = end[end - start >= LEAST["hex"]]
    out = np.zeros(len(bounds) - 1, bool)
    for a, b in zip(np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, ends, "left"), strict=True):
        out[a:b] = True
    return out


def _scan(batches: Iterator[pa.RecordBatch], text: str, threshold: float, redact: str | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, text):
        column = W.column(part, text)
        texts = column.to_pylist()
        found = [scan(t, bool(h), threshold) for t, h in zip(texts, _long_hex(column), strict=True)]
        own = {"secret_spans": pa.array(found, SPANS)}
        if redact is not None:
            own[text] = pa.array([redacted(t, f, redact) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name) for f in schema], schema=schema)


def redacted(text: str, spans: list[dict], mark: str) -> str:
    """The text with each secret value (names of assignments stay) replaced by the mark."""
    out, at = [], 0
    for s, e in sorted((x["value_start"], x["end"]) for x in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, redact: str | None = None) -> DataFrame:
    """keep columns with secret_spans; with ``redact`` also the text, each secret value replaced by that mark."""
    if "secret_spans" in {*keep, text}:
        raise ValueError("a column is named secret_spans")
    columns = list(dict.fromkeys([*keep, text]))
    taken = docs.select(*columns)
    kept = [f for f in taken.schema if f.name in keep or (f.name == text and redact is not None)]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("secret_spans", T._parse_datatype_string(SPANS_SQL))])
    arrow = pa.schema([pa.field(f.name, SPANS if f.name == "secret_spans" else f.type) for f in to_arrow_schema(schema)])
    return taken.mapInArrow(partial(_scan, text=text, threshold=threshold, redact=redact, schema=arrow), schema)
