"""Operator 3: packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a remainder, and the remainder into pieces of at most ``piece``
ids. Full windows stand alone. All other pieces are dealt by hash into blocks of about ``BLOCK`` pieces. Within
a block the two partial partitions of widest spread are merged again and again, the fullest window of one with the
emptiest of the other, until one partition into near-equal windows is left. If a window exceeds the capacity, the
number of windows rises and the block is partitioned anew. A block needs one task, bounded memory, and no other
block, so the work grows in proportion to the pieces.

Defined cases: a null or empty text is its end id alone; a text of any length is cut, never shortened; equal rows are
packed as often as they occur; an empty table gives no pieces; columns of other names are not read. A null
doc_id is packed like any other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm.tokens import crc32_of, default_vocabulary, tokenizer
from framescore.llm.words import slices

WINDOW, PIECE, END_ID = 2048, 512, 1
# Pieces partitioned together: more of them fill windows no better and cost more merges.
BLOCK = 4096

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def piece_bounds(n: int, window: int = WINDOW, piece: int = PIECE) -> list[int]:
    """Where the pieces of n ids begin, and n: full windows, then the remainder in pieces, the last one odd."""
    full = n // window * window
    return [*range(0, full, window), *range(full, n, piece), n]


def cut_pieces(
    docs: DataFrame, window: int = WINDOW, piece: int = PIECE, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece of each document's ids (``PIECES``), with the ids themselves on request."""
    path = vocabulary or default_vocabulary()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                ids, bounds = tokenizer(path).encode(texts.slice(lo, hi - lo))
                rows, spans = [], []
                for i in range(hi - lo):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], END_ID)
                    cuts = piece_bounds(len(own), window, piece)
                    for a, b in zip(cuts, cuts[1:]):
                        rows.append((i, a, b - a, crc32_of(own[a:b]), len(own)))
                        if with_ids:
                            spans.append(own[a:b])
                table = np.array(rows, np.int64).reshape(-1, 5)
                out = [names.slice(lo, hi - lo).take(pa.array(table[:, 0])), *(pa.array(table[:, j]) for j in range(1, 5))]
                fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(spans, pa.list_(pa.int32())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(out, fields)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window of each size among k, and the largest window's sum."""
    n = len(sizes)
    # A partial partition is (sums less their minimum, descending; the minimum; a tree node per window, -1: empty).
    heap: list = [(-int(s), i, None) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    merges: list[tuple[int, np.ndarray, np.ndarray]] = []
    nodes, serial = n, n

    def opened(spread: int, i: int, part):
        if part is not None:
            return part
        sums, trees = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], trees[0] = -spread, i
        return (sums, 0, trees) if k > 1 else (sums * 0, -spread, trees)

    while len(heap) > 1:
        a, low_a, ta = opened(*heapq.heappop(heap))
        b, low_b, tb = opened(*heapq.heappop(heap))
        sums, tb = a + b[::-1], tb[::-1]
        both = np.flatnonzero((ta >= 0) & (tb >= 0))
        trees = np.maximum(ta, tb)
        if len(both):
            merges.append((nodes, ta[both], tb[both]))
            trees[both] = np.arange(nodes, nodes + len(both))
            nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        least = int(sums[-1])
        sums -= least
        heapq.heappush(heap, (-int(sums[0]), serial, (sums, low_a + low_b + least, trees)))
        serial += 1
    sums, low, trees = opened(*heap[0])
    window = np.full(nodes, -1, np.int64)
    window[trees[trees >= 0]] = np.flatnonzero(trees >= 0)
    for first, left, right in reversed(merges):
        own = window[first : first + len(left)]
        window[left], window[right] = own, own
    return window[:n], int(sums[0]) + low


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece, none above capacity, and the number of windows."""
    k = max(1, math.ceil(int(lengths.sum()) / capacity))
    while True:
        window, largest = difference(lengths, k)
        if largest <= capacity:
            return window, k
        k = max(k + 1, math.ceil(k * 1.004))


def _place(block: pd.DataFrame, capacity: int, first: int) -> tuple[pd.DataFrame, int]:
    """Add sequence_id and offset to the pieces of one block; also the number of sequences used."""
    lengths = block["length"].to_numpy()
    alone = lengths >= capacity
    sequence = np.zeros(len(block), np.int64)
    sequence[alone] = np.arange(int(alone.sum()))
    used = int(alone.sum())
    if not alone.all():
        sequence[~alone], k = pack_block(lengths[~alone], capacity)
        sequence[~alone] += used
        used += k
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    begin = np.searchsorted(sequence[order], np.arange(used))
    out = block.iloc[order].copy()
    out["sequence_id"] = first + sequence[order]
    out["offset"] = starts - starts[begin[sequence[order]]]
    return out, used


def pack(pieces: DataFrame, capacity: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Place pieces (doc_id, start, length and any other columns) into sequences of at most ``capacity``.

    Adds sequence_id, unique but not dense, and offset, gapless from 0 in each sequence. The pieces are
    dealt evenly by hash, so a document or source of any size spreads over all tasks, and sorted in each task,
    so a repeated task packs alike.
    """
    extra = {"sequence_id": "bigint", "offset": "bigint"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + [f"{c} {t}" for c, t in extra.items()])

    def run(batches):
        base, held, count = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= block:
                rows = pd.concat(held, ignore_index=True)
                out, used = _place(rows.iloc[:block], capacity, base)
                base += used
                yield out
                held, count = [rows.iloc[block:]], count - block
        if count:
            yield _place(pd.concat(held, ignore_index=True), capacity, base)[0]

    dealt = pieces.repartition("doc_id", "start").sortWithinPartitions("doc_id", "start", "length")
    return dealt.mapInPandas(run, schema)


def sequences(packed: DataFrame, capacity: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The training rows: sequence_id, its ids padded to ``capacity``, and each document's span. Needs ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    padding = F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size(ids))
    return rows.select(
        "sequence_id", F.concat(ids, padding).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("spans"),
    )
