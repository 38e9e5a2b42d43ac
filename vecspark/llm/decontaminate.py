"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is contained in a document only if all its shingles are, so it is enough to
join on one necessary shingle of each window: the prefix, when the window's shingles are ordered by
rarity over all documents. Candidates are cut down by the shingle's place in the window and by the
document's length, then verified word by word.

Two scans of the documents, neither of which shuffles text: one counts in how many documents each
benchmark shingle is, the other joins. Benchmark items are the stated query set; they are handled
in blocks, each broadcast as arrays of word numbers, and a document's hits pass from block to block.
A block holds about ``block_chars`` bytes of text at most and a sixth as many windows, as a word counts for
six bytes at least; long items are cut into pieces that overlap by a window less a word, which have
the same windows. A full block of the default size takes 123 MB of the driver's Python at its peak and
43 MB when broadcast (measured, words of five letters).

Defined cases: NULL texts have no words; an item without words has no windows; items that repeat
count once by id; a NULL item id can hit words but isn't listed; a document without words is not
contaminated; repeated document rows give repeated results; other columns are ignored; an empty
benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes: A-Z in lower case, ASCII other than letters and digits as spaces, the rest as they are.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each shingle of k words; negative where a word is unknown. Known words are
    numbered from 0, fewer than 2^21, so three fit into 63 bits."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, bad = ids[:n].copy(), ids[:n] < 0
    for j in range(1, k):
        out = (out << 21) | ids[j : n + j]
        bad |= ids[j : n + j] < 0
    out[bad] = -1
    return out


def pieces(found: list[bytes], size: int, most: int) -> Iterator[list[bytes]]:
    """The words in pieces of at most ``most`` that have all windows of ``size`` words, each once."""
    step = max(1, most - size + 1)
    for start in range(0, max(1, len(found) - size + 1), step):
        yield found[start : start + step + size - 1]


def _window_codes(rows: np.ndarray, k: int) -> np.ndarray:
    """The codes of each window's shingles, in order."""
    out = rows[:, : rows.shape[1] - k + 1].astype(np.int64)
    for j in range(1, k):
        out = (out << 21) | rows[:, j : j + out.shape[1]]
    return out


@dataclass
class Block:
    """A block of benchmark items: its vocabulary, windows and, for a shingle size k, all codes."""

    vocabulary: dict[bytes, int]
    windows: list[tuple[np.ndarray, np.ndarray]]  # of one length: word numbers (row per window), item numbers
    items: list
    codes: dict[int, np.ndarray]

    @classmethod
    def build(cls, rows: list[tuple[object, list[bytes]]], size: int, shingle: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        items: dict[object, int] = {}
        by_len: dict[int, tuple[list, list]] = {}
        codes: dict[int, list[np.ndarray]] = {}
        for item, found in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in found], dtype=np.int64)
            if not len(ids):
                continue
            number, n = items.setdefault(item, len(items)), min(size, len(ids))
            parts, owners = by_len.setdefault(n, ([], []))
            parts.append(np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), n))
            owners.append(np.full(len(ids) - n + 1, number, np.int32))
            k = min(shingle, n)
            codes.setdefault(k, []).append(np.unique(_codes(ids, k)))
        if len(vocabulary) >= 1 << 21:
            raise ValueError("a block holds too many different words; use smaller blocks")
        windows = []
        for n, (parts, owners) in by_len.items():
            both = np.concatenate([np.concatenate(parts), np.concatenate(owners)[:, None]], axis=1)
            both = np.unique(both.view(np.dtype((np.void, both.shape[1] * 4))).ravel()).view(np.int32).reshape(-1, n + 1)
            windows.append((both[:, :n], both[:, n]))
        return cls(vocabulary, windows, list(items), {k: np.unique(np.concatenate(x)) for k, x in codes.items()})

    def number(self, text: str | None) -> np.ndarray:
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))


def _counts(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block is; as large as the block at most."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        sums = {k: np.zeros(len(c), np.int64) for k, c in b.codes.items()}
        for pdf in batches:
            for text in pdf["text"]:
                ids = b.number(text)
                for k, known in b.codes.items():
                    found = _codes(ids, k)
                    found = np.unique(found[found >= 0])
                    at = np.searchsorted(known, found)
                    at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == found)]
                    sums[k][at] += 1
        for k, s in sums.items():
            at = np.nonzero(s)[0]
            yield pd.DataFrame({"k": np.full(len(at), k), "at": at, "n": s[at]})

    out = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
    found = docs.mapInPandas(run, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    k, at, n = (found.column(c).to_numpy() for c in ("k", "at", "n"))
    for size, sums in out.items():
        sums[at[k == size]] = n[k == size]
    return out


@dataclass
class Index:
    """The prefix shingle of each window, sorted, and what verification needs."""

    block: Block
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # k, prefix codes, places in the window, windows, items

    @classmethod
    def build(cls, block: Block, counts: dict[int, np.ndarray], shingle: int) -> Index:
        tables = []
        for rows, owner in block.windows:
            k = min(shingle, rows.shape[1])
            prefix, place = np.empty(len(rows), np.int64), np.empty(len(rows), np.int8)
            for s in range(0, len(rows), 50_000):  # bounded tables
                codes = _window_codes(rows[s : s + 50_000], k)
                rarity = counts[k][np.searchsorted(block.codes[k], codes)]
                first = np.lexsort((codes, rarity), axis=1)[:, 0]
                place[s : s + 50_000], prefix[s : s + 50_000] = first, codes[np.arange(len(codes)), first]
            order = np.argsort(prefix, kind="stable")
            tables.append((k, prefix[order], place[order], rows[order], owner[order]))
        return cls(Block(block.vocabulary, [], block.items, {}), tables)

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans under occurrences of windows, and the numbers of their items."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        made: dict[int, np.ndarray] = {}
        for k, prefix, place, rows, owner in self.tables:
            if k not in made:
                made[k] = _codes(ids, k)
            at = np.nonzero(made[k] >= 0)[0]
            found = made[k][at]
            lo, hi = np.searchsorted(prefix, found), np.searchsorted(prefix, found, side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            size = rows.shape[1]
            for s in range(0, len(at), 4096):  # bounded blocks of candidates
                a, b, m = at[s : s + 4096], lo[s : s + 4096], n[s : s + 4096]
                for c in range(0, int(m.max(initial=0)), 256):
                    part = np.minimum(np.maximum(m - c, 0), 256)
                    first = np.repeat(b + c, part) + (np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part))
                    start = np.repeat(a, part) - place[first].astype(np.int64)
                    ok = (start >= 0) & (start + size <= len(ids))  # place and length bounds
                    first, start = first[ok], start[ok]
                    same = np.ones(len(first), bool)
                    for j in range(size):
                        same &= ids[start + j] == rows[first, j]
                        if not same.any():
                            break
                    if same.any():
                        items.update(owner[first[same]].tolist())
                        spans += [(x, x + size) for x in np.unique(start[same]).tolist()]
        return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    window: int = 13,
    shingle: int = 3,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``spans`` (merged word spans that benchmark windows
    cover) and ``items`` (the ids of items with occurring windows, as strings)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    piece = max(2 * window, min(50_000, block_chars // 24))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, text in zip(pdf["item_id"].astype(object).where(pdf["item_id"].notna(), None), pdf["text"], strict=True):
                parts = [b" ".join(x) for x in pieces(words(text), window, piece)]
                yield pd.DataFrame({"item_id": pd.Series([item] * len(parts), dtype=object), "words": pd.Series(parts, dtype=object), "cost": [max(len(x), 6 * (x.count(b" ") + 1)) for x in parts]})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(cut, "item_id string, words binary, cost long").distinct()
    n_blocks = max(1, -(-2 * (items.agg(F.sum("cost")).first()[0] or 0) // block_chars) - 1)  # half full on average, as a hash deals
    spark, texts = docs.sparkSession, source.select("text")
    state = source.select("id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<array<long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == k).select("item_id", "words").collect()
        block = Block.build([(r.item_id, bytes(r.words).split()) for r in rows], window, shingle)
        if k < n_blocks - 1 and not block.windows:
            continue
        index = spark.sparkContext.broadcast(Index.build(block, _counts(texts, block) if block.windows else {}, shingle))
        last = k == n_blocks - 1

        def run(batches: Iterator[pd.DataFrame], index=index, last=last) -> Iterator[pd.DataFrame]:
            ix = index.value
            names = ix.block.items
            for pdf in batches:
                n, spans, named = [], [], []
                for text, s, i in zip(pdf["text"], pdf["spans"], pdf["items"], strict=True):
                    ids = ix.block.number(text)
                    more, found = ix.hits(ids)
                    n.append(len(ids))
                    spans.append([list(x) for x in merge([*(tuple(x) for x in (s if s is not None else ())), *more])])
                    named.append(sorted({*(i if i is not None else ()), *(names[x] for x in found if names[x] is not None)}))
                text = None if last else pdf["text"]
                yield pd.DataFrame({"id": pdf["id"], "text": text, "n_words": n, "spans": pd.Series(spans, dtype=object), "items": pd.Series(named, dtype=object)})

        state = state.mapInPandas(run, f"id {kind}, text string, n_words long, spans array<array<long>>, items array<string>")
    return state.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the item ids, and the verdict: a hit, and 5 % of the words at least."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
