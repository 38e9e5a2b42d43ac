"""Secret scanning with multipart credential linking.

Single-pattern detectors find self-evident secrets. Many leaks are only recognisable as a set of
parts: an account name, a random-looking value and the host they open. Each of those alone is
weak, so the linker joins the three kinds of part by interval overlap inside a scope and reports
a weak part only if the parts that complete it are there. Parts that complete each other don't
overlap: what stands inside an identifier or an endpoint is no secret of its own.

Everything happens inside one row, in one pass over the whole text; nothing is shuffled, so a hot
source costs no more than any other rows.

Defined cases: a NULL text counts as empty and has no spans; rows are independent, so repeated
rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds, in the order in which spans with one start are listed; then the linker's kinds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")

_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_WEAK_ID = re.compile(
    r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|key_?id))["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9_.@+-]{3,})""",
    re.ASCII,
)
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:(?:https?|ftp|jdbc:\w{2,12}|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,})|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?![\d.])", re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ID_HINTS = ("user", "login", "account", "client", "key")

SPAN_SCHEMA = "array<struct<kind:string,start:long,end:long,scope:long>>"

#: (kind, start, end, scope); scope is the start of the link's leftmost part, or NULL for a lone base span.
Span = tuple[str, int, int, "int | None"]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the single-pattern detectors, by start, then kind."""
    low, found = text.lower(), []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(value: str) -> bool:
    """Digits and both cases together: a random-looking value, not a word."""
    return any(c.isdigit() for c in value) and any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


class _Sides:
    """Intervals of one kind of part, for overlap tests by binary search.

    Parts of a kind don't overlap one another, so starts and ends are both ascending.
    """

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def near(self, start: int, end: int, reach: int) -> int | None:
        """Start of the first part that meets [start - reach, end + reach)."""
        i = bisect_left(self.ends, start - reach + 1)
        return self.starts[i] if i < len(self.starts) and self.starts[i] < end + reach else None


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def find_spans(text: str | None, scope_chars: int = 240) -> list[Span]:
    """All spans of a text: the base ones, and weak parts whose complements lie within the scope.

    An identifier needs a secret, a secret needs an identifier, and at least one of the two must be
    joined by an endpoint unless the other is itself a base span. An endpoint needs both others.
    """
    if not text:
        return []
    base = base_spans(text)
    low = text.lower()
    taken = _Sides(_disjoint([s[1:] for s in base]))
    free = lambda s, e: taken.near(s, e, 0) is None
    ids = [m.span() for m in _WEAK_ID.finditer(text) if free(*m.span())] if any(h in low for h in _ID_HINTS) else []
    secrets = [m.span() for m in _WEAK_SECRET.finditer(text) if _mixed(m[0]) and free(*m.span())] if ids or base else []
    if not (ids or any(s[0] == "access" for s in base)) or not (secrets or any(s[0] != "access" for s in base)):
        return [(*s, None) for s in base]
    ends = [m.span() for m in _ENDPOINT.finditer(text)]
    # One token can't be two parts: an identifier's value or a piece of an address is no secret.
    named, addressed = _Sides(ids), _Sides(ends)
    secrets = [x for x in secrets if named.near(*x, 0) is None and addressed.near(*x, 0) is None]
    strong_id, strong_secret = _Sides([s[1:] for s in base if s[0] == "access"]), _Sides(_disjoint([s[1:] for s in base if s[0] != "access"]))
    weak_id, weak_secret, endpoint = _Sides(ids), _Sides(secrets), _Sides(ends)
    first = lambda *xs: min((x for x in xs if x is not None), default=None)
    out: list[Span] = []
    for s in base:
        sides = (weak_secret, strong_secret) if s[0] == "access" else (weak_id, strong_id)
        mate = first(*(x.near(s[1], s[2], scope_chars) for x in sides))
        out.append((*s, None if mate is None else min(mate, s[1])))
    for kind, spans, strong, weak in (("weak_id", ids, strong_secret, weak_secret), ("weak_secret", secrets, strong_id, weak_id)):
        for s, e in spans:
            mate = strong.near(s, e, scope_chars)
            if mate is None and endpoint.near(s, e, scope_chars) is not None:
                mate = weak.near(s, e, scope_chars)
            if mate is not None:
                out.append((kind, s, e, min(mate, s)))
    for s, e in ends:
        a = first(strong_id.near(s, e, scope_chars), weak_id.near(s, e, scope_chars))
        b = first(strong_secret.near(s, e, scope_chars), weak_secret.near(s, e, scope_chars))
        if a is not None and b is not None:
            out.append(("endpoint", s, e, min(a, b, s)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_chars: int = 240) -> DataFrame:
    """One row per document: its id and ``spans`` (kind, start, end in code points, scope)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[dict(zip(("kind", "start", "end", "scope"), s, strict=True)) for s in find_spans(t, scope_chars)] for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "spans": pd.Series(found, dtype=object)})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(run, f"id {kind}, spans {SPAN_SCHEMA}").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan`'s spans."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
