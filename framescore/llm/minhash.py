"""Operator 10: near-duplicates by ProbMinHash over weighted word shingles.

A document is a multiset of five-word shingles; the weight of a shingle is how often it occurs. Two documents are alike by their
probability Jaccard similarity: with v and w the weights scaled to sum to 1, the chance that both pick one shingle when all
shingles race by exponential times of rates v and w. It is the plain Jaccard similarity if no shingle repeats, and
1 less it is a metric.

Each shingle sends out a Poisson process of rate its weight. An arrival goes to a register picked at random and stays there if it
is the earliest. Arrivals are drawn in rounds for all shingles of a block of documents; a shingle stops once its next
arrival is later than all registers of its document (early termination), so a long text costs about one draw a shingle.

1. Equal texts are one node (md5 of the text), named by its least doc_id.
2. ``BANDS`` bands of ``ROWS`` registers each; nodes that agree in a band share a bucket. A pair at 0.8 shares
   none with probability (1 - 0.8^5)^32 = 3e-6.
3. Pairs around bucket centres are verified by their exact similarity, from whole texts, and links joined into classes (``linking``).
   Texts of large buckets that are still apart are joined by their rarest shingles, so that no pair at 0.8 among them is left out.
4. Every document gets its node's class: the least doc_id of its component.

Defined cases: a null text or doc_id is never a duplicate: its class is its own doc_id; blank texts (no word) are near
only to equal texts; a text of 1 to 4 words is one shingle; equal rows share a class; an empty table gives no rows;
columns of other names are not read by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.llm.linking import link_all
from framescore.llm.scratch import Scratch
from framescore.llm.words import hash_words, mix, shingles, slices

K, LEAST = 5, 0.8
BANDS, ROWS = 32, 5


def weighted_shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight), sorted by row and shingle: each row's distinct shingles."""
    words = hash_words(texts)
    run, at = shingles(words, k, whole=True)
    row = np.searchsorted(words.first, at, side="right") - 1
    order = np.lexsort((run, row))
    run, row = run[order], row[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], run[first], np.diff(np.append(first, len(run)))


def prob_minhash(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """The element in each register of each row, (n_rows, registers); 0 where a row has no element."""
    best = np.full((n_rows, registers), np.inf)
    held = np.zeros((n_rows, registers), np.uint64)
    flat, kept = best.reshape(-1), held.reshape(-1)
    row, element, rate = rows, elements, weights.astype(np.float64)
    time, worst, turn = np.zeros(len(row)), np.full(n_rows, np.inf), 0
    while len(row):
        turn += 1
        bits = mix(element + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        # 40 bits for the waiting time, the rest for the register.
        time = time - np.log(((bits >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / rate
        at = row * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, at, time)
        won = flat[at] == time
        kept[at[won]] = element[won]
        worst = best.max(axis=1)
        alive = time < worst[row]
        row, element, rate, time = row[alive], element[alive], rate[alive], time[alive]
    return held


def probability_jaccard(x: np.ndarray, nx: np.ndarray | None, y: np.ndarray, ny: np.ndarray | None) -> float:
    """Exact, for two sorted sets of elements with their weights (None: all 1)."""
    if len(x) == 0 or len(y) == 0:
        return float(len(x) == len(y))
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if nx is None and ny is None:
        return len(common) / (len(x) + len(y) - len(common))
    nx = np.ones(len(x)) if nx is None else np.asarray(nx, np.float64)
    ny = np.ones(len(y)) if ny is None else np.asarray(ny, np.float64)
    v, w = nx[ix], ny[iy]
    only_x, only_y = nx.sum() - v.sum(), ny.sum() - w.sum()
    ratios, which = np.unique(v / w, return_inverse=True)
    won = np.bincount(which, v)
    return float(sum(g / (only_x + r * only_y + np.maximum(v, r * w).sum()) for r, g in zip(ratios, won)))


def sketches(docs: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(doc_id, key, bands): key is the text's md5, bands one hash per band, none for a text without words."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts):
                row, element, weight = weighted_shingles(texts.slice(lo, hi - lo))
                held = prob_minhash(row, element, weight, hi - lo, bands * per_band).reshape(hi - lo, bands, per_band)
                sums = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (hi - lo, 1))
                for j in range(per_band):
                    sums = mix(sums ^ held[:, :, j])
                has = np.zeros(hi - lo, bool)
                has[row] = True
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], ["doc_id", "key", "bands"])

    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>")


def _shingle_rows(joined: DataFrame) -> DataFrame:
    """(key, roles, elements, weights) from (key, roles, text); weights are empty if all are 1."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts):
                row, element, weight = weighted_shingles(texts.slice(lo, hi - lo))
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                plain = np.ones(hi - lo, bool)
                plain[row[weight > 1]] = False
                sizes = np.where(plain, 0, np.diff(ends))
                elements = pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))
                weights = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(weight[~plain[row]].astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), elements, weights], ["key", "roles", "elements", "weights"])

    roles = joined.schema["roles"].dataType.simpleString()
    return joined.select("key", "roles", "text").mapInArrow(run, f"key binary, roles {roles}, elements array<bigint>, weights array<int>")


def _element_rows(texts: DataFrame) -> DataFrame:
    """(key, element, weight, total) of (key, text): one row per distinct shingle.

    With shares s and t of the two texts' weights on common shingles, probability Jaccard is at most 1 / (1 / s + 1 / t - 1): a common
    shingle with shares a and b of those adds at most 1 / ((1/s - 1) / a + (1/t - 1) / b + max(1/a, 1/b)), which is concave
    and of first degree in (a, b), so the sum is at most its value at the sums, a = b = 1. For plain sets it is the similarity itself.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for lo, hi in slices(column):
                row, element, weight = weighted_shingles(column.slice(lo, hi - lo))
                total = np.bincount(row, weight, hi - lo).astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(element.view(np.int64)), pa.array(weight.astype(np.int64)), pa.array(total)],
                    ["key", "element", "weight", "total"],
                )

    return texts.mapInArrow(run, "key binary, element bigint, weight bigint, total bigint")


def _similarity(one, other) -> float:
    (x, nx), (y, ny) = one, other
    weights = lambda n: n if len(n) else None
    return probability_jaccard(np.asarray(x).view(np.uint64), weights(nx), np.asarray(y).view(np.uint64), weights(ny))


def classes(docs: DataFrame, scratch: Scratch, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id), one row per row of ``docs``: the least doc_id of the document's class."""
    made = scratch.write(sketches(docs), "sketches")
    texts = scratch.write(made.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("key", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")), "texts")

    def read_texts(keys: DataFrame) -> DataFrame:
        wanted = keys.join(texts.select("key", "rep"), "key")
        whole = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("rep"), "text")
        # The same join at every size: what would be broadcast grows with the data.
        return whole.join(wanted.hint("merge"), "rep").where(F.unhex(F.md5("text")) == F.col("key")).select("key", "text")

    members = texts.select("key", F.explode("bands").alias("band"))
    _, named = link_all(members, read_texts, _shingle_rows, _similarity, least, scratch, _element_rows)
    with_reps = texts.select("key", "rep").join(named, "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    heads = with_reps.groupBy("component").agg(F.min("rep").alias("class_id"))
    named_texts = scratch.write(with_reps.join(heads, "component").select("key", "class_id"), "classes")
    found = made.select("doc_id", "key").join(named_texts, "key").select("doc_id", "class_id")
    apart = docs.where("doc_id IS NULL OR text IS NULL").select(F.col("doc_id").cast("bigint"), F.col("doc_id").cast("bigint").alias("class_id"))
    return found.unionByName(apart)


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each class, the one of least doc_id; equal rows of one doc_id stay once."""
    found = scratch.write(classes(docs, scratch), "found")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
    rest = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_id"), "left_anti")
    # doc_ids that occur several times are few: only their rows are compared as a whole.
    again = scratch.write(found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "again")
    once = rest.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    return once.unionByName(rest.join(again, F.col("doc_id") == F.col("_id"), "left_semi").dropDuplicates())
