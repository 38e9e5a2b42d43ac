"""Near-duplicates by b-bit MinHash, with exact confirmation.

Each text becomes its set of word shingles. Equal sets are one class; everything below works on one
representative per class. ``bands`` of ``rows`` minima give candidates; the low ``bits`` of further
minima, packed into longs, give an estimate of the similarity, corrected for chance collisions, by
counting bits; candidates whose estimate is compatible with the threshold are confirmed on the full
sets.

All pairs of a bucket are never made. First each bucket's members are paired with its smallest
member only. The components of the confirmed links then leave few buckets with several components,
and only there pairs across components are made, once for all buckets that a pair shares, and only
those that sizes and estimate allow. Links inside a component can't change the result. Shingles
that no other text in those buckets has can't be shared; a text with many of them is far from all
others, so most loners of a large group drop out before any of their pairs is made.

With 24 bands of 4 minima a pair at similarity 0.8 shares no band once in 300,000 times, and one at
0.85 once in 20 million times; the estimate's margin loses about as few.

Defined cases: NULL and empty texts have an empty set and are linked with nothing; a text with fewer
words than a shingle has its whole word sequence as one shingle; rows that repeat a text are one
class; rows that share an id but not their words are different texts with one name, each linked for
itself; a NULL id never names a component unless all rows of a class have none; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import materialize
from vecspark.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Params:
    """``percent``: links need 100 * intersection >= percent * union."""

    shingle: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 4
    bits: int = 4
    signature: int = 512
    #: Standard deviations that an estimate may lie below the threshold.
    margin: float = 4.5
    seed: int = 20_240_601

    @property
    def least_matches(self) -> int:
        """Positions of the signature that must agree for a pair to be confirmed."""
        p = self.percent / 100
        match = p + (1 - p) / (1 << self.bits)
        return max(0, int(self.signature * match - self.margin * (self.signature * match * (1 - match)) ** 0.5))


class _Words(dict):
    """Hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Hasher:
    """Shingle sets and signatures; one per worker."""

    def __init__(self, params: Params):
        self.p, self.table = params, _Words()
        rng = np.random.default_rng(params.seed)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mixers = odd(params.shingle)
        self.final = odd(2)
        n = params.bands * params.rows + params.signature
        self.mul = (odd(n) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.band_mix = odd(params.rows)

    def _mix(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * self.final[0]
        h = (h ^ (h >> np.uint64(29))) * self.final[1]
        return h ^ (h >> np.uint64(32))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        k = min(self.p.shingle, len(h))
        n = len(h) - k + 1
        total = np.full(n, np.uint64(k))
        for j in range(k):
            total += self._mix(h[j : n + j] + self.mixers[j]) * self.mixers[j]
        return np.unique(self._mix(total))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), 2048):  # blocks that stay in the cache
            part = x[s : s + 2048][None, :] * self.mul
            part += self.add
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def bands(self, minima: np.ndarray) -> np.ndarray:
        m = minima[: self.p.bands * self.p.rows].astype(np.uint64).reshape(self.p.bands, self.p.rows)
        return self._mix((self._mix(m + self.band_mix) * self.band_mix).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        b = self.p.bits
        low = (minima[self.p.bands * self.p.rows :] & np.uint32((1 << b) - 1)).astype(np.uint64)
        low = low.reshape(-1, 64 // b) << (np.arange(64 // b, dtype=np.uint64) * np.uint64(b))
        return np.bitwise_or.reduce(low, axis=1).view(np.int64)


def matches(a: Column, b: Column, params: Params) -> Column:
    """How many positions of two packed signatures agree."""
    bits, lanes = params.bits, 64 // params.bits
    ones = sum(1 << (bits * i) for i in range(lanes))
    ones -= (1 << 64) if ones >= 1 << 63 else 0
    differ = F.lit(0)
    for k in range(params.signature // lanes):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        folded = x
        for j in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, j))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))
    return F.lit(params.signature) - differ


def similarity(matched: Column, params: Params) -> Column:
    """The similarity that so many agreeing positions stand for, without chance collisions."""
    chance = 1 / (1 << params.bits)
    return F.greatest(F.lit(0.0), (matched / params.signature - chance) / (1 - chance))


def signatures(docs: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """(id, n, cls, bands, sig) of each row; cls is the same for equal sets only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(params)
        for pdf in batches:
            n, cls, bands, sig = [], [], [], []
            for text in pdf["text"]:
                s = h.shingles(text)
                n.append(len(s))
                m = h.minima(s) if len(s) else None
                cls.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                bands.append(h.bands(m) if len(s) else None)
                sig.append(h.packed(m) if len(s) else None)
            yield pd.DataFrame({"id": pdf["id"], "n": n, "cls": cls, "bands": pd.Series(bands, dtype=object), "sig": pd.Series(sig, dtype=object)})

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, "id long, n long, cls string, bands array<long>, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, params: Params) -> DataFrame:
    """(rep, set) of the wanted representatives (rep, doc, cls)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hasher(params)
        for pdf in batches:
            sets = [h.shingles(t) for t in pdf["text"]]
            same = np.array([xxhash.xxh3_128_hexdigest(s.tobytes()) == c for s, c in zip(sets, pdf["cls"], strict=True)], bool)
            out = pd.DataFrame({"rep": pdf["rep"], "set": pd.Series([s.view(np.int64) for s in sets], dtype=object)})
            yield out[same]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = source.join(wanted, F.col("id") == F.col("doc")).select("rep", "cls", "text")
    return rows.mapInPandas(run, "rep long, set array<long>").dropDuplicates(["rep"])


def _confirmed(edges: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for pdf in batches:
            keep = []
            for a, x, y in zip(pdf["a"], pdf["x"], pdf["y"], strict=True):
                if a != last:
                    last, own = a, np.asarray(x)
                other = np.asarray(y)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= params.percent * (len(own) + len(other) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    rows = edges.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    rows = rows.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _sizes_fit(m: Column, n: Column, params: Params) -> Column:
    return 100 * F.least(m, n) >= params.percent * F.greatest(m, n)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """One row per document row: id, ``n_shingles``, ``component_id`` and ``kept``."""
    p = params or Params()
    sig = materialize(signatures(docs, id_col, text_col, p))
    classes = sig.where("n > 0 AND id IS NOT NULL").groupBy("cls")
    reps = materialize(classes.agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    # A class goes by its smallest id; where rows share that but not their words, all but one of
    # their classes go by a hash instead.
    named = reps.groupBy("doc").agg(F.min("cls").alias("first"), F.count("*").alias("m"))
    doubled = named.where("m > 1").limit(1).count() > 0
    if doubled:
        reps = reps.join(named.select("doc", "first"), "doc").withColumn("rep", F.when(F.col("cls") == F.col("first"), F.col("doc")).otherwise(F.xxhash64("cls"))).drop("first")
        reps = materialize(reps)
    else:
        reps = reps.withColumn("rep", F.col("doc"))

    # Buckets of several classes; rows of others end here.
    rows = reps.select("rep", F.posexplode("bands").alias("band", "hash"))
    least = rows.groupBy("band", "hash").agg(F.min("rep").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    buckets = materialize(rows.join(least, ["band", "hash"]))
    facts = reps.select("rep", "n", "sig")
    wanted = reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "doc", "cls")
    sets = materialize(_sets(docs, wanted, id_col, text_col, p))

    def allowed(edges: DataFrame) -> DataFrame:
        x, y = (facts.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
        out = edges.join(y, "b").join(x, "a")
        return out.where(_sizes_fit(F.col("na"), F.col("nb"), p) & (matches(F.col("sa"), F.col("sb"), p) >= p.least_matches)).select("a", "b")

    stars = allowed(buckets.where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    first = components(_confirmed(stars, sets, p))

    # Pairs across components, in the buckets that still have several.
    labelled = buckets.select("band", "hash", "rep").join(first.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    open_ = labelled.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "hash")
    member = materialize(labelled.join(open_, ["band", "hash"]))
    ids = member.select("rep").distinct()
    grams = sets.join(ids, "rep", "left_semi").select("rep", F.explode("set").alias("gram"))
    alone = grams.groupBy("gram").agg(F.count("*").alias("m"), F.min("rep").alias("rep")).where("m = 1")
    own = alone.groupBy("rep").agg(F.count("*").alias("own"))
    fact = reps.select("rep", "n", "sig", "bands").join(ids, "rep", "left_semi").join(own, "rep", "left")
    fact = fact.withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(100 * F.col("most") >= p.percent * F.col("n"))
    member = materialize(member.join(fact.drop("own"), "rep"))
    x, y = member.alias("x"), member.alias("y")
    both = F.least(F.col("x.most"), F.col("y.most"))  # of any intersection
    shared = F.array_position(F.zip_with(F.col("x.bands"), F.col("y.bands"), lambda a, b: a == b), True)
    across = x.join(
        y,
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.hash") == F.col("y.hash"))
        & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * both >= p.percent * (F.col("x.n") + F.col("y.n") - both))
        & (matches(F.col("x.sig"), F.col("y.sig"), p) >= p.least_matches)
        & (shared == F.col("x.band") + 1),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))
    across = materialize(across)
    found = _confirmed(across.select("a", "b"), sets, p).join(across, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    second = components(found)

    final = first.select("id", F.col("component").alias("c1"))
    final = reps.select("cls", "doc", F.col("rep").alias("id")).join(final, "id", "left").withColumn("c1", F.coalesce("c1", "id"))
    final = final.join(second.select(F.col("id").alias("c1"), "component"), "c1", "left").select("cls", "doc", F.coalesce("component", "c1").alias("component_id"))
    if doubled:  # hashes name no component
        least = final.groupBy("component_id").agg(F.min("doc").alias("least"))
        final = final.join(least, "component_id").select("cls", F.col("least").alias("component_id"))
    final = final.select("cls", "component_id")
    out = sig.select("id", "n", "cls").join(final, "cls", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
