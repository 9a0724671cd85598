"""Operator 6: fingerprints by randomised edit embedding.

A text walks over its own characters: at step j it puts out the character under its pointer, and a random bit that
depends on j and that character alone says whether the pointer moves on. All texts share the bits. The outputs of two texts of edit
distance d differ in O(d^2) places, as their walks fall into step again behind each edit; outputs of unrelated texts agree
only by chance. A text of n characters walks 3n steps, by when its end is reached and blanks follow.

The fingerprint samples the output: steps are cut into octaves ([0, 64), [64, 128), [128, 256), ...), and from each one
``SAMPLES`` places are read, the same for all texts; a sample is a hash of three outputs in a row, one of 15 hex digits, or 0
behind the end. So the whole text is covered at any length, in 64 digits per doubling. The likeness of two
fingerprints is the share of agreeing samples, octaves weighed by length, less what agrees by chance.

All texts of a block walk together, a step at a time, so a step costs three NumPy calls for thousands of texts.

Near copies: bands of sampled digits give buckets (``near_classes``), pairs are verified by exact edit distance.

Defined cases: a null text is the empty text; two empty texts are alike (1.0); equal texts have equal fingerprints; texts of any
length are walked whole; an empty table gives no rows; a null doc_id comes last in the order of documents; equal rows follow each other.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.llm.linking import link_all
from framescore.llm.scratch import Scratch
from framescore.llm.words import mix

SAMPLES, RUN, FIRST = 64, 3, 64
# Bands of each octave, and digits of each band.
BANDS, DIGITS = 8, 5
SEED = 20240607
# Characters of one block of texts that walk together.
BLOCK_CHARS = 24_000_000
_TOP = np.uint16(15)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _multipliers(first: int, n: int) -> list[np.uint16]:
    """A random odd number for each step. A pointer over character class c moves if the top bit of its product with c is set.

    The end is class 0, on which a pointer rests; no two classes differ by 2^15, so their moves are independent enough.
    """
    draws = mix(np.arange(first, first + n, dtype=np.uint64) + np.uint64(SEED << 32))
    return list((draws & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1))


@lru_cache(maxsize=64)
def _places(octave: int) -> np.ndarray:
    """The sampled steps of an octave, ascending; each begins a run inside it."""
    lo, hi = (0, FIRST) if octave == 0 else (FIRST << (octave - 1), FIRST << octave)
    draws = mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(SEED + octave * 1000))
    return np.sort(lo + (draws % np.uint64(hi - lo - RUN + 1)).astype(np.int64))


def _classes(text: str) -> np.ndarray:
    """Characters as 1 to 32,749: ASCII letters and most alphabets keep apart."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (cp % np.uint32(32749) + np.uint32(1)).astype(np.uint16)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    # Each text is followed by its end, on which the pointer rests.
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.zeros(int(starts[-1]), np.uint16)
    for i, s in zip(order, starts):
        if lengths[i]:
            flat[s : s + lengths[i]] = _classes(texts[i])
    at, out = starts[:-1].copy(), [[] for _ in texts]
    step, octave = 0, 0
    active = int(np.searchsorted(-sizes, 0))
    while active:
        hi = FIRST << octave
        places = _places(octave)
        wanted = np.unique((places[:, None] + np.arange(RUN)).reshape(-1))
        column = {int(p): j for j, p in enumerate(wanted)}
        seen = np.zeros((len(wanted), active), np.uint16)
        while step < hi and active:
            stop = min(hi, step + 4096)
            here = at[:active]
            under, move = np.empty(active, np.uint16), np.empty(active, np.uint16)
            for j, by in enumerate(_multipliers(step, stop - step), step):
                np.take(flat, here, out=under, mode="clip")
                if j in column:
                    seen[column[j], :active] = under
                np.multiply(under, by, out=move)
                np.right_shift(move, _TOP, out=move)
                np.add(here, move, out=here)
            step = stop
            active = int(np.searchsorted(-sizes, -(step / 3)))
        digits = np.zeros((seen.shape[1], SAMPLES), np.uint8)
        for j, p in enumerate(places):
            run = [seen[column[int(p) + r]].astype(np.uint64) for r in range(RUN)]
            code = run[0] | (run[1] << np.uint64(16)) | (run[2] << np.uint64(32))
            digits[:, j] = np.where(run[0] > 0, mix(code + np.uint64(1)) % np.uint64(15) + np.uint64(1), 0)
        for i, row in enumerate(_DIGITS[digits]):
            out[order[i]].append(row.tobytes().decode())
        octave += 1
    return ["".join(x) for x in out]


def likeness(a: str, b: str) -> float:
    """Estimated share of equal outputs of two embeddings, 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, "0").encode(), np.uint8).reshape(-1, SAMPLES) for s in (a, b))
    some = (x != 48) | (y != 48)
    octaves = np.arange(len(x))
    weight = np.where(octaves == 0, FIRST, FIRST * 2.0 ** (octaves - 1)) / SAMPLES
    total = float(weight @ some.sum(axis=1))
    agree = float(weight @ ((x == y) & some).sum(axis=1)) / total if total else 1.0
    return min(1.0, max(0.0, (agree - 1 / 15) / (1 - 1 / 15)))


def fingerprint_column() -> Column:
    """A pandas UDF: the fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.fillna("").tolist()), dtype=object)

    return run


def _buckets(ids: DataFrame, n: int) -> list[int]:
    """Ascending bounds that cut the ids into about n equal parts: at most n - 1 numbers reach the driver."""
    if n < 2:
        return []
    cuts = ids.stat.approxQuantile("_k", [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(c) for c in cuts})


def with_next(docs: DataFrame, per_bucket: int = 4000, max_buckets: int = 4096) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) in descending doc_id, so dealt that each meets its successor.

    Ids are cut at quantiles into buckets that are sorted one by one. A bucket's last document is followed by the first of
    the bucket below, of which a copy is sent along; the very last is followed by the very first. Adds _bucket, and _copy, which
    is true for the copies. Texts are shuffled once. Buckets only bound the size of a sort; beyond ``max_buckets``, larger ones spill.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("_k"))
    ids = keyed.select("_k")
    n = ids.count()
    bounds = _buckets(ids, min(max_buckets, -(-n // per_bucket)))
    powers = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    bucket = F.lit(0)
    if bounds:
        table = F.lit([int(b) for b in bounds])
        # Binary search: how many bounds are at most the id.
        bucket = F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda acc, s: F.when(F.get(table, acc + s - 1) <= F.col("_k"), acc + s).otherwise(acc))
    keyed = keyed.withColumn("_bucket", bucket)
    tops = sorted((r["_bucket"], r["top"]) for r in keyed.groupBy("_bucket").agg(F.max("_k").alias("top")).collect())
    to: dict[int, list[int]] = {}
    for (b, _), (_, top) in zip(tops[1:], tops):
        to.setdefault(top, []).append(b)
    if tops:
        to.setdefault(tops[-1][1], []).append(tops[0][0])
    spark = docs.sparkSession
    extra = spark.createDataFrame([(k, v) for k, v in to.items()] or [(0, [])], "_top bigint, _to array<int>")
    rows = keyed.join(F.broadcast(extra), F.col("_k") == F.col("_top"), "left")
    own = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")))
    copies = F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("c")))
    sent = rows.withColumn("_s", F.explode(F.concat(own, copies))).select("doc_id", "text", "_k", F.col("_s.b").alias("_bucket"), F.col("_s.c").alias("_copy"))
    return sent.repartition("_bucket").sortWithinPartitions("_bucket", "_copy", F.col("_k").desc(), F.xxhash64("text"))


NEXT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def next_digests(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The edited text has its last floor(n / 2) characters replaced by as many of the next document's first ones.
    """

    def block(ids: list, texts: list[str]) -> pd.DataFrame:
        """All but the last text, which is the next of the one before it."""
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
        prints = fingerprints(texts + edited)
        own, changed = prints[: len(texts)], prints[len(texts) :]
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts[:-1]],
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": own[:-1], "edited_fingerprint": changed,
            "near_edited": [likeness(a, b) for a, b in zip(own, changed)], "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
        })

    def run(batches):
        ids, texts, bucket, size, closed = [], [], None, 0, False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc, text, own, copy in zip(*columns):
                if own != bucket:
                    ids, texts, bucket, size, closed = [], [], own, 0, False
                if closed:
                    continue
                texts.append(text)
                size += len(text)
                if copy:
                    # The bucket's end: only the first copy is the next document.
                    closed = True
                else:
                    ids.append(doc)
                if closed or (size > BLOCK_CHARS and len(texts) > 1):
                    done = ids if closed else ids[:-1]
                    yield pa.RecordBatch.from_pandas(block(done, texts), schema=shape, preserve_index=False)
                    ids, texts, size = ids[len(done) :], texts[-1:], len(text)

    shape = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in NEXT.split(", "))])
    return with_next(docs).select(F.col("doc_id").cast("bigint"), "text", "_bucket", "_copy").mapInArrow(run, NEXT)


def edit_similarity(a: str, b: str) -> float:
    """1 less the edit distance over the longer length: bit-parallel rows (Myers) on whole numbers of any size."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, distance = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        distance += bool(ph & top) - bool(mh & top)
        ph = ph << 1 | 1
        pv, mv = (mh << 1 | ~(xv | ph)) & full, ph & xv & full
    return 1 - distance / len(b)


def bands_of(prints: Column, bands: int = BANDS, digits: int = DIGITS) -> Column:
    """One hash per octave and band of sampled digits, of bands without a blank.

    All octaves from the first one on: where a text is unchanged over an octave, and its walk is in step, all bands of the octave agree.
    """
    picks = [sorted({int(x) for x in mix(np.arange(digits, dtype=np.uint64) + np.uint64(977 * b)) % np.uint64(SAMPLES)}) for b in range(bands)]
    octaves = F.sequence(F.lit(0), (F.length(prints) / SAMPLES).cast("int") - 1)

    def one(octave: Column, b: int) -> Column:
        drawn = F.concat(*[F.substring(prints, octave * SAMPLES + 1 + i, F.lit(1)) for i in picks[b]])
        return F.when(~F.contains(drawn, F.lit("0")), F.xxhash64(octave, F.lit(b), drawn))

    every = F.flatten(F.transform(octaves, lambda o: F.array(*[one(o, b) for b in range(bands)])))
    return F.filter(every, lambda x: x.isNotNull())


def near_classes(docs: DataFrame, scratch: Scratch, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id): texts joined by edit similarities of at least ``least``; the class is its least doc_id.

    Texts meet in bands of their walk from the front and of the walk from the back, so an unchanged stretch at either end is enough. Words
    changed at random: pairs of 120 words meet with probability 1.00 at similarity 0.95, 0.99 at 0.89 and 0.93 at 0.79; pairs of 1,000 words
    with 0.99, 0.97 and 0.91 (300 pairs each). Larger buckets are searched by draws.
    """
    prints = fingerprint_column()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text", F.unhex(F.md5("text")).alias("key"))
    walked = texts.select("doc_id", "key", prints("text").alias("front"), prints(F.reverse("text")).alias("back"))
    made = scratch.write(walked.select("doc_id", "key", F.concat(*[bands_of(F.col(c)) for c in ("front", "back")]).alias("bands")), "prints")
    reps = scratch.write(made.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("key", F.col("m.doc_id").alias("rep"), F.col("m.bands").alias("bands")), "reps")

    def read_texts(keys: DataFrame) -> DataFrame:
        wanted = keys.join(reps.select("key", "rep"), "key")
        return texts.select(F.col("doc_id").alias("rep"), "text", F.col("key").alias("own")).join(wanted.hint("merge"), "rep").where("own = key").select("key", "text")

    members = reps.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    _, named = link_all(members, read_texts, lambda rows: rows, lambda a, b: edit_similarity(a[0], b[0]), least, scratch)
    every = reps.select("key", "rep").join(named, "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    heads = every.groupBy("component").agg(F.min("rep").alias("class_id"))
    found = made.select("doc_id", "key").join(scratch.write(every.join(heads, "component").select("key", "class_id"), "classes"), "key")
    apart = docs.where("doc_id IS NULL OR text IS NULL").select(F.col("doc_id").cast("bigint"), F.col("doc_id").cast("bigint").alias("class_id"))
    return found.select("doc_id", "class_id").unionByName(apart)
