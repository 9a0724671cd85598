"""Operator 12: a Katz backoff language model, fitted and evaluated by exchanges between blocks of texts and tables of n-grams.

The probability of a word after a history of n - 1 words is

    P(w | h) = d(c) * c(h, w) / (c(h) + KEPT)       if the n-gram (h, w) was seen c(h, w) times in training
             = alpha(h) * P(w | h without its first word)    if not

d is the Good-Turing discount of counts up to ``SMALL`` (1 above), from the numbers of n-grams seen once, twice and so on. The lowest order gives what
the discounts free to one unknown word. alpha(h) = (1 - sum of P over words seen after h) / (1 - sum of the lower order's P over them),
so the probabilities after every history sum to 1. ``KEPT`` of a count is kept back after every history: else words never seen after one whose
counts are all above ``SMALL`` would be impossible. An unseen history has alpha 1.

Texts lie in blocks of about ``BLOCK`` bytes, written once as numbered words. n-grams are 64-bit hashes, dealt to parts by their
first bits. Every pass is an exchange:

1. A block sends each part its distinct n-grams (sorted, packed) with their training counts. So a very frequent n-gram is one entry a block.
2. A part adds the counts up, stores them as its part of the model's table, and answers every block in the order it asked:
   the total, and whether the block is the n-gram's owner (the first that trained on it).
3. Owners send the sums of a history's probabilities, by history; the answer is alpha, for histories after which the block has an unseen word.
4. A block evaluates the recursion for its distinct n-grams, and adds up its documents' words.

Blocks are bucketed by their number, so the passes that bring answers back to them do not move the words again. Count-of-counts and totals
are sums over parts, a few numbers.

The tables are (part, n, keys, payload) rows: sorted hashes and their counts or alphas; ``table`` reads them as one row per n-gram.

Defined cases: a null text is empty: it has one token, its end; a null doc_id is the empty string to the rule of held-out documents; rows of
equal doc_id are documents of their own; an empty table gives no rows; with nothing to train on, the unknown word has probability 1. If the numbers of counts do
not give discounts between 0 and 1 for ``SMALL`` counts, fewer are discounted; if for none, half a count is taken off every count. Columns of
other names are not read. One text is worked on in one task, in memory of about 150 bytes a word; a part has to hold its n-grams of all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.llm.scratch import Scratch, shuffle_tasks
from framescore.llm.sqltext import crc32
from framescore.llm.words import hash_words, mix, slices

ORDER, SMALL, KEPT = 2, 5, 0.05
BLOCK = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
# The hashes of the token before a text and of the one after it.
BEGIN, END = (int(mix(np.array([x], np.uint64))[0]) for x in (0x6265, 0x656E))
ANSWER, TABLE, STATS = 0, 1, 2
_EXCHANGE = "kind int, block bigint, part int, n int, keys binary, payload binary, stats array<bigint>"


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: the high bytes of small or sorted numbers vanish."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return pa.compress(raw.T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among sorted keys, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


@dataclass
class Discounts:
    """One order's discounts and totals: ``of_counts[r - 1]`` n-grams were seen r times in training."""

    of_counts: list[int]
    total: int
    distinct: int

    def __post_init__(self):
        self.table = None
        n = [0, *self.of_counts]
        for most in range(len(self.of_counts) - 1, 0, -1):
            if min(n[1 : most + 2]) == 0:
                continue
            share = (most + 1) * n[most + 1] / n[1]
            if share >= 1:
                continue
            found = [((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share) for r in range(1, most + 1)]
            if all(0 < d < 1 for d in found):
                self.table = np.array([1.0, *found, 1.0])
                break

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        if self.table is None:
            return np.maximum(counts - 0.5, 0)
        return self.table[np.minimum(counts, len(self.table) - 1)] * counts

    @property
    def freed(self) -> float:
        """What the discounts take off all counts together."""
        if self.table is None:
            return self.distinct / 2
        return float(sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(self.of_counts, self.table[1:]), 1)))


class _Texts:
    """The n-grams of one block. ``grams(n)`` numbers the distinct n-grams; ``at`` holds each place's, -1 where it has none."""

    def __init__(self, lengths: np.ndarray, held: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray):
        self.lengths, self.vocabulary, self.tokens = lengths, vocabulary, tokens
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.trains = ~held[self.doc]
        self.place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.keys, self.at, self.history, self.suffix, self._orders = [None, vocabulary], [None, tokens], [None, None], [None, None], {}

    def upto(self, n: int) -> None:
        """Number all n-grams up to order ``n``."""
        for order in range(len(self.keys), n + 1):
            where = np.flatnonzero(self.place >= order - 1)
            below, words = self.at[-1], len(self.vocabulary)
            code, first, own = np.unique(below[where - 1] * words + self.tokens[where], return_index=True, return_inverse=True)
            history = code // words
            at = np.full(len(self.tokens), -1, np.int64)
            at[where] = own
            self.keys.append(mix(self.keys[-1][history] * _ODD + self.vocabulary[code % words]))
            self.history.append(history)
            self.suffix.append(below[where[first]])
            self.at.append(at)

    def order(self, n: int) -> np.ndarray:
        """The n-grams in the order of their keys, in which they are sent."""
        if n not in self._orders:
            self._orders[n] = np.argsort(self.keys[n])
        return self._orders[n]

    def counts(self, n: int) -> np.ndarray:
        used = self.at[n][self.trains & (self.at[n] >= 0)]
        return np.bincount(used, minlength=len(self.keys[n]))


def _read_block(row: dict) -> _Texts:
    lengths, words, tokens = np.array(row["lengths"], np.int64), row["n_words"], row["n_tokens"]
    return _Texts(lengths, np.array(row["held"], bool), _unpacked(row["vocabulary"], words, np.uint64), _unpacked(row["tokens"], tokens, np.uint32).astype(np.int64))


def blocks(docs: DataFrame, held: Column, size: int = BLOCK) -> DataFrame:
    """(block, ids, held, lengths, n_words, vocabulary, n_tokens, tokens): texts as numbers of words, the most frequent word first."""
    kind = "block bigint, ids array<bigint>, held array<boolean>, lengths array<int>, n_words int, vocabulary binary, n_tokens int, tokens binary"
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches):
        for batch in batches:
            texts = pc.ascii_lower(batch.column(2).fill_null(""))
            for lo, hi in slices(texts, size):
                words = hash_words(texts.slice(lo, hi - lo))
                lengths = np.diff(words.first) + 2
                ends = np.cumsum(lengths)
                stream = np.full(int(ends[-1]), BEGIN, np.uint64)
                stream[np.arange(len(words.hashes)) + 2 * words.row() + 1] = words.hashes
                stream[ends - 1] = END
                found, own, counts = np.unique(stream, return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None], pa.int64()), pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                        pa.array([batch.column(1).slice(lo, hi - lo).to_pylist()], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                        pa.array([len(found)], pa.int32()), pa.array([_packed(found[order])]), pa.array([len(stream)], pa.int32()), pa.array([_packed(rank[own])]),
                    ],
                    names,
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, kind).withColumn("block", F.monotonically_increasing_id())


def _sent(batches, ask):
    """Packed rows (part, block, n, keys, counts, sums) that ``ask`` gives for each block row."""
    names = ["part", "block", "n", "keys", "one", "two", "wanted"]
    for batch in batches:
        for row in batch.to_pylist():
            out = list(ask(row))
            columns = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_SENT = "part int, block bigint, n int, keys binary, one binary, two binary, wanted binary"


def _counts_of(texts: DataFrame, n: int, parts: int, most: int) -> DataFrame:
    """``_EXCHANGE`` rows of order n: totals for each block, the table, and the numbers of counts."""

    def ask(row):
        block = _read_block(row)
        block.upto(n)
        order = block.order(n)
        keys, counts = block.keys[n][order], block.counts(n)[order]
        cuts = _cuts(keys, parts)
        for part in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[part], cuts[part + 1]
            yield int(part), row["block"], int(b - a), _packed(keys[a:b]), _packed(counts[a:b]), None, None

    def answer(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        keys = np.concatenate([_unpacked(r["keys"], r["n"], np.uint64) for r in rows])
        counts = np.concatenate([_unpacked(r["one"], r["n"], np.int64) for r in rows])
        whose = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
        found, own = np.unique(keys, return_inverse=True)
        total = np.bincount(own, counts, len(found)).astype(np.int64)
        # The first block that trained on it, whose entry is written last.
        trained = np.flatnonzero(counts > 0)[::-1]
        owner = np.full(len(found), -1)
        owner[own[trained]] = whose[trained]
        part, out, lo = rows[0]["part"], [], 0
        replies = 2 * total[own] + (owner[own] == whose)
        for r in rows:
            out.append((ANSWER, r["block"], part, r["n"], None, _packed(replies[lo : lo + r["n"]]), None))
            lo += r["n"]
        seen = total > 0
        out.append((TABLE, None, part, int(seen.sum()), _packed(found[seen]), _packed(total[seen]), None))
        seen &= found != np.uint64(BEGIN)
        of_counts = np.bincount(np.minimum(total[seen], most + 2), minlength=most + 3)[1 : most + 2]
        out.append((STATS, None, part, 0, None, None, [*of_counts.tolist(), int(total[seen].sum()), int(seen.sum())]))
        return _exchange_rows(out)

    sent = texts.mapInArrow(lambda batches: _sent(batches, ask), _SENT)
    return sent.groupBy("part").applyInArrow(answer, _EXCHANGE)


def _exchange_rows(out: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _EXCHANGE.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


class _Evaluated:
    """A block's probabilities, order by order, from the answers it got."""

    def __init__(self, row: dict, discounts: list[Discounts], order: int):
        self.block = _read_block(row)
        self.block.upto(order)
        self.replies: dict[tuple[str, int], list] = {}
        for r in sorted(row["answers"] or [], key=lambda r: r["part"]):
            self.replies.setdefault((r["what"], r["level"]), []).append(r)
        self.discounts = discounts
        self.count, self.owned, self.p = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        for n in range(1, order + 1):
            got = np.concatenate([_unpacked(r["payload"], r["n"], np.int64) for r in self.replies["count", n]])
            back = np.empty_like(got)
            back[self.block.order(n)] = got
            self.count[n], self.owned[n] = back >> 1, back % 2 == 1

    def lowest(self) -> None:
        d, c = self.discounts[1], self.count[1]
        unknown = d.freed / d.total if d.total else 1.0
        self.p[1] = np.where(c > 0, d(c) / max(d.total, 1), unknown)

    def seen(self, n: int) -> np.ndarray:
        """The probabilities of the n-grams seen in training, 0 for others."""
        return self.discounts[n](self.count[n]) / (self.count[n - 1][self.block.history[n]] + KEPT)

    def wanted(self, n: int) -> np.ndarray:
        """Which histories have an unseen word here: seen histories only."""
        out = np.zeros(len(self.count[n - 1]), bool)
        out[self.block.history[n][self.count[n] == 0]] = True
        return out & (self.count[n - 1] > 0)

    def next(self, n: int) -> None:
        """The recursion of order n, with the alphas that were asked for."""
        alpha = np.ones(len(self.count[n - 1]))
        order = self.block.order(n - 1)
        asked = order[self.wanted(n)[order]]
        if len(asked):
            alpha[asked] = np.concatenate([_unpacked(r["payload"], r["n"], np.float64) for r in self.replies["alpha", n] if r["n"]])
        block = self.block
        self.p[n] = np.where(self.count[n] > 0, self.seen(n), alpha[block.history[n]] * self.p[n - 1][block.suffix[n]])


def _alphas_of(texts: DataFrame, n: int, parts: int, discounts: list[Discounts]) -> DataFrame:
    """``_EXCHANGE`` rows: alpha of the histories of order n, for the blocks that want it, and the table of all."""

    def ask(row):
        made = _Evaluated(row, discounts, n)
        made.lowest()
        for lower in range(2, n):
            made.next(lower)
        block, own = made.block, made.owned[n]
        history = block.history[n][own]
        size = len(made.count[n - 1])
        upper = np.bincount(history, made.seen(n)[own], size)
        lower = np.bincount(history, made.p[n - 1][block.suffix[n]][own], size)
        wanted = made.wanted(n)
        order = block.order(n - 1)
        order = order[(upper > 0)[order] | wanted[order]]
        keys = block.keys[n - 1][order]
        cuts = _cuts(keys, parts)
        for part in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[part] : cuts[part + 1]]
            yield int(part), row["block"], len(at), _packed(block.keys[n - 1][at]), _packed(upper[at]), _packed(lower[at]), _packed(wanted[at])

    def answer(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        together = lambda c, kind: np.concatenate([_unpacked(r[c], r["n"], kind) for r in rows])  # noqa: E731
        found, own = np.unique(together("keys", np.uint64), return_inverse=True)
        upper, lower = (np.bincount(own, together(c, np.float64), len(found)) for c in ("one", "two"))
        alpha = np.maximum(1 - upper, 0) / np.maximum(1 - lower, np.finfo(float).tiny)
        wanted, out, lo, part = together("wanted", bool), [], 0, rows[0]["part"]
        for r in rows:
            mine = own[lo : lo + r["n"]][wanted[lo : lo + r["n"]]]
            out.append((ANSWER, r["block"], part, len(mine), None, _packed(alpha[mine]), None))
            lo += r["n"]
        out.append((TABLE, None, part, len(found), _packed(found), _packed(alpha), None))
        return _exchange_rows(out)

    sent = texts.mapInArrow(lambda batches: _sent(batches, ask), _SENT)
    return sent.groupBy("part").applyInArrow(answer, _EXCHANGE)


def _scored(texts: DataFrame, order: int, discounts: list[Discounts]) -> DataFrame:
    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = _Evaluated(row, discounts, order)
                made.lowest()
                for n in range(2, order + 1):
                    made.next(n)
                block, d = made.block, discounts[1]
                logs = np.zeros(len(block.tokens))
                for n in range(1, order + 1):
                    has = block.at[n] >= 0
                    logs[has] = np.log10(made.p[n])[block.at[n][has]]
                told = block.place > 0
                per_doc = lambda x: np.bincount(block.doc[told], x[told], len(block.lengths))  # noqa: E731
                base = np.log10((made.count[1] + 1) / (d.total + d.distinct + 1))[block.tokens]
                known = (made.count[1] > 0).astype(float)[block.tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(block.lengths - 1), pa.array(per_doc(known).astype(np.int64)),
                        pa.array(per_doc(base)), pa.array(per_doc(logs)),
                    ],
                    [c.split()[0] for c in kind.split(", ")],
                )

    return texts.mapInArrow(run, kind)


class Katz:
    """A model of one table's training documents, and the scores of all its documents."""

    def __init__(self, docs: DataFrame, held: Column, scratch: Scratch, order: int = ORDER, small: int = SMALL, block: int = BLOCK):
        spark = docs.sparkSession
        self.order, self.scratch, parts = order, scratch, shuffle_tasks(spark)
        texts = scratch.bucketed(blocks(docs, held, block), "blocks", "block", parts)
        self.counts, self.alphas, self.discounts, replies = [None], [None, None], [None], []
        for n in range(1, order + 1):
            made = scratch.write(_counts_of(texts, n, parts, small), f"counts{n}", by="kind")
            self.counts.append(made.where(F.col("kind") == TABLE))
            self.discounts.append(_discounts(made.where(F.col("kind") == STATS), small))
            replies.append(_replies(made, "count", n))
        answered = _with_answers(texts, replies)
        for n in range(2, order + 1):
            made = scratch.write(_alphas_of(answered, n, parts, self.discounts), f"alphas{n}", by="kind")
            self.alphas.append(made.where(F.col("kind") == TABLE))
            replies.append(_replies(made, "alpha", n))
            answered = _with_answers(texts, replies)
        self._answered = answered

    def scores(self) -> DataFrame:
        """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
        made = _scored(self._answered, self.order, self.discounts)
        return made.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.discounts[1].total).cast("bigint").alias("train_tokens"), "base_score", "score")

    def table(self, n: int, what: str = "counts") -> DataFrame:
        """(gram, value): the stored counts of order n, or the alphas of histories of order n's n-grams (``what`` "alphas")."""
        kind, of = (np.int64, self.counts) if what == "counts" else (np.float64, self.alphas)

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    columns = [pa.array(_unpacked(row["keys"], row["n"], np.int64)), pa.array(_unpacked(row["payload"], row["n"], kind))]
                    yield pa.RecordBatch.from_arrays(columns, ["gram", "value"])

        return of[n].select("n", "keys", "payload").mapInArrow(run, f"gram bigint, value {'bigint' if what == 'counts' else 'double'}")


def _discounts(stats: DataFrame, small: int) -> Discounts:
    sums = stats.select(*[F.sum(F.col("stats")[i]) for i in range(small + 3)]).first()
    numbers = [int(x or 0) for x in sums]
    return Discounts(numbers[: small + 1], *numbers[small + 1 :])


def _replies(made: DataFrame, what: str, level: int) -> DataFrame:
    found = made.where(F.col("kind") == ANSWER)
    return found.select("block", F.struct(F.lit(what).alias("what"), F.lit(level).alias("level"), "part", "n", "payload").alias("r"))


def _with_answers(texts: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each block with all its answers: they are no larger than the block."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    # The blocks stay where they are: they are bucketed by the number that the answers are dealt by.
    return texts.join(every.groupBy("block").agg(F.collect_list("r").alias("answers")).hint("merge"), "block")


def held_out(remainder: int = 2, modulo: int = 7) -> Column:
    """Documents whose crc32 of the doc_id, as text, leaves that remainder."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulo == remainder


def _discount_sql(counts: str) -> str:
    """One row (d, n, v): the discounts that hold (null: half a count), all counts together, and how many there are."""
    return f"""
    SELECT any_value(n) AS n, any_value(v) AS v, max_by(d, most) FILTER (len(d) > 0 AND list_min(d) > 0 AND list_max(d) < 1) AS d
    FROM (
        SELECT n, v, most, CASE WHEN list_min(k[1:most + 1]) > 0 AND (most + 1) * k[most + 1] < k[1] THEN
            list_transform(range(1, most + 1), lambda r:
                ((r + 1) * k[r + 1] / k[r] / r - (most + 1) * k[most + 1] / k[1]) / (1 - (most + 1) * k[most + 1] / k[1])) END AS d
        FROM (
            SELECT sum(c) AS n, count(*) AS v, [{", ".join(f"count(*) FILTER (c = {r})" for r in range(1, SMALL + 2))}] AS k FROM {counts}
        ), range(1, {SMALL + 1}) AS t(most)
    )"""


def _discounted_sql(c: str, d: str) -> str:
    return f"CASE WHEN {d} IS NULL THEN {c} - 0.5 WHEN {c} <= len({d}) THEN {d}[{c}] * {c} ELSE {c} END"


# Bigrams over words of the tables. The tokens before and after a text hold a space, as no word does.
ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS id, doc_id, {crc32("coalesce(doc_id::VARCHAR, '')")} % 7 = 2 AS held,
           list_concat([' begin'], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), [' end']) AS t
    FROM documents
),
pairs AS (SELECT id, held, unnest(t[:-2]) AS h, unnest(t[2:]) AS w FROM docs),
ones AS (SELECT w, count(*) AS c FROM pairs WHERE NOT held GROUP BY w),
twos AS (SELECT h, w, count(*) AS c FROM pairs WHERE NOT held GROUP BY h, w),
histories AS (SELECT h, sum(c) AS c FROM twos GROUP BY h),
d1 AS ({_discount_sql("ones")}),
d2 AS ({_discount_sql("twos")}),
p1 AS (SELECT w, c, ({_discounted_sql("c", "d")}) / n AS p FROM ones, d1),
unknown AS (SELECT coalesce((SELECT (any_value(n) - sum({_discounted_sql("c", "d")})) / any_value(n) FROM ones, d1), 1) AS p),
p2 AS (SELECT t.h, t.w, ({_discounted_sql("t.c", "d")}) / (h.c + {KEPT}) AS p FROM twos t JOIN histories h USING (h), d2),
alphas AS (SELECT p2.h, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 USING (w) GROUP BY p2.h),
told AS (
    SELECT x.id, count(*) AS n_tokens, count(p1.w) AS n_known, sum(log10((coalesce(p1.c, 0) + 1) / (coalesce(d1.n, 0) + d1.v + 1))) AS base,
           sum(log10(coalesce(p2.p, coalesce(a.a, 1) * coalesce(p1.p, unknown.p)))) AS score
    FROM pairs x CROSS JOIN d1 CROSS JOIN unknown LEFT JOIN p1 ON p1.w = x.w LEFT JOIN p2 ON p2.h = x.h AND p2.w = x.w LEFT JOIN alphas a ON a.h = x.h
    GROUP BY x.id
)
SELECT doc_id, held AS held_out, n_tokens, n_known, coalesce(d1.n, 0)::BIGINT AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN told USING (id), d1
"""
