"""Hierarchical packing of documents into sequences of several lengths.

Documents are routed to tiers of window sizes that are powers of two. Whole windows are cut off
long documents; what remains goes to the smallest tier that holds it. Tiers are packed from the
longest down, and the gap that an item leaves in its window is filled with items of shorter tiers,
the largest that fits first, then with a piece cut off the next larger one. A window is thus full
when it is emitted and needs no padding; the few tokens left at the end of a partition are cut into
full windows of falling size. Sequences of one tier that add up to ``step_tokens`` form a step
group, so steps have equal numbers of tokens; only the last group of a tier in a partition may have
fewer, and a partition's last rest is cut into windows shorter than the smallest tier, down to one
token, each its own length as tier.

Packing is local to a partition and streams: nothing is shuffled, gathered or counted globally, a
hot source changes nothing, and a retried task repeats its own output. Memory holds one buffer of
``buffer_tokens`` plus the longest document. Sequence ids carry the partition in their high bits.

Defined cases: a NULL text is an empty one and holds just the end token; a NULL id is kept as it
is; repeated rows are packed as often as they occur; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.tokens import byte_bpe_encoder

#: Sequences that are handed on at a time.
BATCH = 256

#: An item: (tokens, arrival number, id, start in its document, ids, the document's tokens).
Item = tuple[int, int, object, int, np.ndarray, int]


@dataclass
class Packer:
    """Packs a stream of token arrays; ``take`` returns the finished sequences."""

    max_len: int = 1024
    min_tier: int = 64
    step_tokens: int = 65_536
    buffer_tokens: int = 2_000_000
    base: int = 0
    pool: list[Item] = field(default_factory=list)
    done: list[tuple[int, int, int, list[Item]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.max_len & (self.max_len - 1) or self.min_tier & (self.min_tier - 1) or self.min_tier > self.max_len:
            raise ValueError("max_len and min_tier must be powers of two, min_tier the smaller")
        self.tiers = [1 << k for k in range(self.max_len.bit_length() - 1, self.min_tier.bit_length() - 2, -1)]
        self.arrivals = self.sequences = self.pooled = self.groups = 0
        self.group_of: dict[int, tuple[int, int]] = {}  # tier -> (group, tokens in it)

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while total - at >= self.max_len:
            self._emit([self._item(doc_id, at, ids[at : at + self.max_len], total)], self.max_len)
            at += self.max_len
        if at < total:
            self._keep(self._item(doc_id, at, ids[at:], total))
        if self.pooled >= self.buffer_tokens:
            self._pack()

    def _item(self, doc_id: object, start: int, ids: np.ndarray, total: int) -> Item:
        """Has its own copy of the ids, so that a short rest doesn't hold a long document."""
        self.arrivals += 1
        return (len(ids), self.arrivals, doc_id, start, ids.copy(), total)

    def _keep(self, item: Item) -> None:
        insort(self.pool, item, key=lambda x: x[:2])
        self.pooled += item[0]

    def _pop(self, i: int) -> Item:
        item = self.pool.pop(i)
        self.pooled -= item[0]
        return item

    def _cut(self, item: Item, n: int) -> tuple[Item, Item]:
        return self._item(item[2], item[3], item[4][:n], item[5]), self._item(item[2], item[3] + n, item[4][n:], item[5])

    def _emit(self, items: list[Item], tier: int) -> None:
        group, tokens = self.group_of.get(tier, (None, self.step_tokens))
        if tokens + tier > self.step_tokens:
            group, tokens, self.groups = self.groups, 0, self.groups + 1
        self.group_of[tier] = (group, tokens + tier)
        self.done.append((self.base + self.sequences, tier, self.base + group, items))
        self.sequences += 1

    def _pack(self) -> None:
        """Fills windows, tier after tier, until shorter items don't fill another."""
        for tier in self.tiers:
            below = tier // 2 if tier > self.min_tier else 0
            while (i := bisect_right(self.pool, tier, key=lambda x: x[0]) - 1) >= 0 and self.pool[i][0] > below and self.pooled >= tier:
                window = [self._pop(i)]
                gap = tier - window[0][0]
                while gap:
                    j = bisect_right(self.pool, gap, key=lambda x: x[0]) - 1
                    if j >= 0:
                        item = self._pop(j)
                    else:  # nothing fits whole
                        item, rest = self._cut(self._pop(bisect_left(self.pool, gap, key=lambda x: x[0])), gap)
                        self._keep(rest)
                    window.append(item)
                    gap -= item[0]
                self._emit(window, tier)

    def finish(self) -> None:
        """Packs what is left: full windows of falling size."""
        self._pack()
        tier = self.max_len
        while self.pool:
            while tier > self.pooled:
                tier //= 2
            window, gap = [], tier
            while gap:
                item = self._pop(len(self.pool) - 1)
                if item[0] > gap:
                    item, rest = self._cut(item, gap)
                    self._keep(rest)
                window.append(item)
                gap -= item[0]
            self._emit(window, tier)

    def take(self) -> list[tuple[int, int, int, list[Item]]]:
        out, self.done = self.done, []
        return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_len: int = 1024,
    min_tier: int = 64,
    step_tokens: int = 65_536,
    buffer_tokens: int = 2_000_000,
    end_id: int = 0,
    with_ids: bool = True,
    make_encoder: Callable = byte_bpe_encoder,
) -> DataFrame:
    """One row per piece: the document's id, where the piece starts in it, its length and ids, the
    document's tokens, the sequence, the offset there, the tier and the step group."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    fields = {"start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "doc_tokens": T.LongType(), "sequence_id": T.LongType(), "offset": T.LongType(), "tier": T.IntegerType(), "step_group": T.LongType()}
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, t) for n, t in fields.items())])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        packer = Packer(max_len, min_tier, step_tokens, buffer_tokens, TaskContext.get().partitionId() << 33)
        end, id_type = np.array([end_id], dtype="<u4"), None

        def rows() -> Iterator[pa.RecordBatch]:
            done = packer.take()
            for k in range(0, len(done), BATCH):  # at most BATCH * max_len ids
                pieces, columns = [], [[] for _ in range(9)]
                for sequence, tier, group, items in done[k : k + BATCH]:
                    offset = 0
                    for n, _, doc, start, ids, total in items:
                        for column, value in zip(columns, (doc, start, n, zlib.crc32(ids.tobytes()), total, sequence, offset, tier, group), strict=True):
                            column.append(value)
                        pieces.append(ids)
                        offset += n
                arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int32() if name == "tier" else pa.int64()) for c, name in zip(columns[1:], fields, strict=True))]
                if with_ids:
                    starts = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(pieces).view("<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            id_type = batch.column("id").type
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    packer.add(doc, np.concatenate([encode(text or ""), end]))
                    if len(packer.done) >= BATCH:
                        yield from rows()
        packer.finish()
        yield from rows()

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
