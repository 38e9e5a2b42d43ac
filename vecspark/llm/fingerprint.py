"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the sums of c[j] * B^j mod 2^31 - 1; the hash of any span is the
difference of two entries, scaled to a common power. Equality of spans is then a comparison of two
numbers (under two bases), and the longest common extension of two positions a binary search.

A fingerprint is the text's length, its hash under both bases, and the k smallest scrambled hashes
of all its spans of ``width`` code points. Equal texts have equal fingerprints; likeness is the
usual bottom-k estimate of the share of spans that two texts have in common.

Defined cases: a NULL text is an empty one; texts shorter than a span have one span; the document
after the last is the first; rows that share an id follow one another in the order of their texts;
a NULL id comes before all others; one row alone is its own next; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003_927, 1_403_580_611)
#: Texts are hashed in blocks of so many code points, so memory is bounded for any length.
BLOCK = 1 << 17
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x below 2^62, without divisions."""
    x = (x & P) + (x >> _SHIFT)
    x = (x & P) + (x >> _SHIFT)
    return np.where(x == P, np.uint64(0), x)


class Powers:
    """B^0 .. B^(BLOCK + width) mod P, and the falling powers that bring spans to one scale."""

    def __init__(self, base: int, width: int):
        up, p, n = [1], int(P), BLOCK + width
        for _ in range(n):
            up.append(up[-1] * base % p)
        self.base, self.up = base, np.array(up, np.uint64)
        self.down = self.up[::-1].copy()  # B^(n - i) at i


def codes(text: str) -> np.ndarray:
    """Code points plus one, so that a span of zeros doesn't vanish."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


class PrefixHash:
    """Prefix arrays of one text under all bases, for span queries."""

    def __init__(self, text: str):
        c = codes(text)
        self.n, self.sums, self.pows = len(c), [], []
        for b in BASES:
            up = np.empty(self.n + 1, np.uint64)
            up[0] = 1
            size = 1
            while size <= self.n:  # doubling: powers from size on are those before, times B^size
                step = np.uint64(pow(b, size, int(P)))
                more = min(size, self.n + 1 - size)
                up[size : size + more] = _mod(up[:more] * step)
                size += more
            total = np.zeros(self.n + 1, np.uint64)
            for s in range(0, self.n, BLOCK):
                some = c[s : s + BLOCK]
                part = np.cumsum(_mod(some * up[s : s + len(some)]))
                total[s + 1 : s + 1 + len(part)] = _mod(total[s] + part)
            self.sums.append(total)
            self.pows.append(up)

    def span(self, start: int, end: int, scale: int) -> tuple[int, ...]:
        """The span's hashes, as if it began at position ``scale`` (>= start)."""
        p = int(P)
        return tuple((int(s[end]) - int(s[start])) % p * pow(b, scale - start, p) % p for s, b in zip(self.sums, BASES, strict=True))

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        top = max(i, j)
        return self.span(i, i + length, top) == other.span(j, j + length, top)

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension of position i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(i, other, j, mid) else (lo, mid - 1)
        return lo


class Fingerprinter:
    """Makes fingerprint strings; one per worker, as its tables are reused."""

    def __init__(self, width: int = 8, k: int = 64):
        self.width, self.k = width, k
        self.powers = [Powers(b, width) for b in BASES]

    def _whole(self, c: np.ndarray) -> list[int]:
        out, p = [], int(P)
        for pw in self.powers:
            total, scale = 0, 1
            for s in range(0, len(c), BLOCK):
                part = c[s : s + BLOCK]
                total = (total + int(_mod(part * pw.up[: len(part)]).sum()) % p * scale) % p
                scale = scale * pow(pw.base, len(part), p) % p
            out.append(total)
        return out

    def _smallest(self, c: np.ndarray) -> np.ndarray:
        w, k, pw, best = self.width, self.k, self.powers[0], np.empty(0, np.uint64)
        if not len(c):
            return best
        if len(c) < w:
            h = np.array([self._whole(c)[0]], np.uint64)
            return (h * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        for s in range(0, len(c) - w + 1, BLOCK):
            part = c[s : s + BLOCK + w - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_mod(part * pw.up[: len(part)]), out=sums[1:])
            sums = _mod(sums)
            n = len(part) - w + 1
            h = _mod(_mod(sums[w:] + P - sums[:n]) * pw.down[:n])
            h = (h * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            if len(best) == k:
                h = h[h < best[-1]]
            elif n > 16 * k:  # the smallest are most likely among these; else all are sorted
                low = np.unique(h[h < np.uint64((1 << 32) * 8 * k // n)])
                h = low if len(low) >= k else h
            best = np.unique(np.concatenate([best, h]))[:k]
        return best

    def __call__(self, text: str) -> str:
        c = codes(text)
        a, b = self._whole(c)
        return f"{len(c):x}.{a:08x}{b:08x}." + "".join(f"{x:08x}" for x in self._smallest(c).tolist())


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans, from two fingerprints alone; 1 if they are equal."""
    if a == b:
        return 1.0
    x, y = a.rpartition(".")[2], b.rpartition(".")[2]
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (x, y))
    least = sorted(x | y)[: max(len(x), len(y))]
    return sum(v in x and v in y for v in least) / len(least) if least else 0.0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts_per_task: int = 4) -> tuple[DataFrame, list[int]]:
    """Rows (part, after, key, id, text) in which each part ends with the first row of the next.

    Parts are ranges of ids that begin at ids that occur, near quantiles; so the first id of a part
    is its bound, and just these rows are needed twice.
    """
    spark = docs.sparkSession
    first = -(1 << 63)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(first)).alias("key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = parts_per_task * n
    marks = source.agg(F.percentile_approx("key", [i / n_parts for i in range(n_parts)], F.lit(10 * n_parts)).alias("q")).first().q or []
    marks = sorted({int(x) for x in marks})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": np.searchsorted(np.array(marks, np.int64), pdf["key"].to_numpy(np.int64), side="right"), "key": pdf["key"]})

    # The first id of each part, exactly: these ids are the bounds. As many rows as parts.
    firsts = sorted(r.low for r in source.select("key").mapInPandas(near, "part int, key long").groupBy("part").agg(F.min("key").alias("low")).collect())
    low, bounds = (firsts[0], firsts[1:]) if firsts else (None, [])
    kind = source.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edge = np.array(bounds, np.int64)
        for pdf in batches:
            key = pdf["key"].to_numpy(np.int64)
            part = np.searchsorted(edge, key, side="right")
            yield pdf.assign(part=part, after=0)
            again = (part > 0) & (key == edge[np.maximum(part, 1) - 1]) if len(edge) else np.zeros(len(key), bool)
            yield pdf[again].assign(part=part[again] - 1, after=1)
            yield pdf[key == low].assign(part=len(edge), after=2)

    rows = source.mapInPandas(deal, f"id {kind}, text string, key long, part int, after int")
    return rows.repartition(n, "part").sortWithinPartitions("part", "after", "key", "text"), bounds


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 8, k: int = 64) -> DataFrame:
    """Fingerprints of each text and of its edit, in which the next document's beginning replaces
    the last quarter; their likeness, and the likeness of the text's to the next document's."""
    rows, _ = with_next(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprinter(width, k)
        held: tuple | None = None  # (part, id, text, fingerprint) that waits for its next row
        for pdf in batches:
            out = []
            for doc, text, part, after in zip(pdf["id"].astype(object).where(pdf["id"].notna(), None), pdf["text"], pdf["part"], pdf["after"], strict=True):
                if held is None and after:
                    continue  # a further row with the id of a part's bound
                own = make(text)
                if held is not None and held[0] == part:
                    n = len(held[2])
                    cut = n - n // 4
                    edited = held[2][:cut] + text[: n // 4]
                    edit = make(edited)
                    kept = cut + PrefixHash(held[2][cut:]).common(0, PrefixHash(edited[cut:]), 0)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], n, digest, held[3], edit, likeness(held[3], edit), likeness(held[3], own), kept))
                held = None if after else (part, doc, text, own)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return rows.select("id", "text", "part", "after").mapInPandas(run, schema).withColumnRenamed("id", id_col)
