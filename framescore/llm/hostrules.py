"""Operator 5: quality rules with host-level verdicts. DataFrame functions only.

1. Every document is measured in its row: words, symbols, repeated lines, repeated three-word windows.
2. Two base rules judge the document alone: fewer than 50 words, or over half of its words in repeated windows.
3. Further rules (``HOST_RULES``) are noisy for one document, so the host decides what a failure is worth. Failures
   are summed by host (partially before the shuffle, one row per host after it), and each host's rate is shrunk to
   (failures + a) / (documents + a + b), with a beta prior (a, b) fitted to the rates of all hosts by their mean and
   variance. A host whose shrunk rate is at least ``LEAST`` is untrusted for that rule.
4. Host verdicts are joined back. A document is rejected by a rule that it fails itself if its host is
   untrusted for the rule. So a clean document of a bad host stays, and so does an odd one of a good host.

The measures are written once, narrow, and read for the host sums and for the join, so texts are read once and never
shuffled here. The join's sides are plain tables, so a host with a third of all rows is split by AQE.

Windows are compared by a 64-bit hash of their three words: two different windows of one document are taken for equal with
probability 2^-64. All work on a document is done in its row, in time n log n.

Defined cases: a null or blank text has no words and fails the base; a null source is a host of its own; equal rows
count as often as they occur; an empty table gives no rows; a text of any length is measured whole; other columns are
not read by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.staging import compute_once
from framescore.llm.scratch import Scratch
from framescore.llm.words import SPACES

SYMBOLS = "#*$%&|<>"
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
LEAST = 0.01
# Whole numbers only, so that any engine decides alike.
HOST_RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 5 * n_lines",
    "repeats": "10 * n_repeat_words > 3 * n_words",
    "lengths": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, ``MEASURES``, n_lines), one row per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", words.alias("w"), lines.alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    rows = compute_once(rows, "h", F.transform("w", lambda w: F.xxhash64(w)))
    n = F.size("h")
    rows = rows.select(
        "doc_id", "source", "word_chars", "n_symbols", "h",
        n.cast("bigint").alias("n_words"), F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
    )
    windows = F.when(n < 3, F.array().cast("array<struct<key:bigint,at:int>>")).otherwise(F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("key"), i.alias("at")),
    )))
    rows = compute_once(rows, "s", windows)
    # A window is repeated if the one before or after it in key order has the same key.
    same = lambda i, x: F.coalesce(F.get("s", i)["key"] == x["key"], F.lit(False))
    repeated = F.filter("s", lambda x, i: same(i - 1, x) | same(i + 1, x))
    rows = compute_once(rows, "p", F.sort_array(F.transform(repeated, lambda x: x["at"])))
    # In order of place, a window covers three words less those that the one before has covered.
    covered = F.aggregate(
        "p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.least(F.lit(3), at - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    return rows.select("doc_id", "source", *[c for c in MEASURES if c != "n_repeat_words"], "n_lines", covered.alias("n_repeat_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, and for each rule the failures, the shrunk rate, and whether it is untrusted.

    The prior's moments are one row, read as scalar subqueries.
    """
    fails = [F.sum(F.expr(f"CAST(({sql}) AS INT)")).cast("double").alias(f"fails_{r}") for r, sql in HOST_RULES.items()]
    hosts = measured.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n_docs"), *fails)
    moments = hosts.agg(*[
        c for r in HOST_RULES for c in (
            F.avg(F.col(f"fails_{r}") / F.col("n_docs")).alias(f"mean_{r}"),
            F.coalesce(F.var_samp(F.col(f"fails_{r}") / F.col("n_docs")), F.lit(0.0)).alias(f"var_{r}"),
        )
    ])
    out = hosts
    for r in HOST_RULES:
        mean, var = moments.select(f"mean_{r}").scalar(), moments.select(f"var_{r}").scalar()
        out = out.withColumn("_m", mean).withColumn("_v", var)
        # Strength of the prior, a + b: large where hosts hardly differ; none can be fitted where the mean is 0 or 1.
        strength = F.when((F.col("_m") <= 0) | (F.col("_m") >= 1), F.lit(1.0)).when(
            F.col("_v") <= 1e-12, F.lit(1e6)
        ).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("_m") * (1 - F.col("_m")) / F.col("_v") - 1)))
        rate = (F.col(f"fails_{r}") + F.col("_m") * strength) / (F.col("n_docs") + strength)
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"untrusted_{r}", F.round(rate, 9) >= LEAST).drop("_m", "_v")
    return out


def judge(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, ``MEASURES``, base_failed, kept), one row per row of ``docs``."""
    return _judged(scratch.write(measure(docs), "measures"), scratch).select("doc_id", *MEASURES, "base_failed", "kept")


def _judged(measured: DataFrame, scratch: Scratch) -> DataFrame:
    hosts = scratch.write(host_rates(measured), "hosts").withColumnRenamed("source", "host")
    rejected = " OR ".join(f"(untrusted_{r} AND ({sql}))" for r, sql in HOST_RULES.items())
    return (
        measured.join(hosts, F.col("source").eqNullSafe(F.col("host")))
        .withColumn("base_failed", F.expr(BASE))
        .withColumn("kept", ~F.col("base_failed") & ~F.expr(rejected))
    )


def keep(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that pass. A doc_id with several rows stays if one of them passes and its text is kept whole."""
    passed = _judged(scratch.write(measure(docs), "measures"), scratch)
    rejected = passed.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("kept").alias("_any")).where(~F.col("_any"))
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
li AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN li USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, unnest([struct_pack(rule := 1, fails := 10 * n_symbols > n_words), struct_pack(rule := 2, fails := 10 * n_dup_lines > 5 * n_lines),
         struct_pack(rule := 3, fails := 10 * n_repeat_words > 3 * n_words),
         struct_pack(rule := 4, fails := word_chars < 3 * n_words OR word_chars > 12 * n_words)], recursive := true)
  FROM m),
h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(fails::INT)::DOUBLE AS k FROM f GROUP BY source, rule),
p AS (
  SELECT rule, avg(k / n) AS mean, coalesce(var_samp(k / n), 0) AS var FROM h GROUP BY rule),
s AS (
  SELECT rule, mean, CASE WHEN mean <= 0 OR mean >= 1 THEN 1.0 WHEN var <= 1e-12 THEN 1e6
         ELSE least(1e6, greatest(1.0, mean * (1 - mean) / var - 1)) END AS strength FROM p),
v AS (
  SELECT source, rule, round((k + mean * strength) / (n + strength), 9) >= 0.01 AS untrusted FROM h JOIN s USING (rule)),
b AS (
  SELECT f.doc_id, bool_or(fails AND untrusted) AS bad FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source AND f.rule = v.rule GROUP BY f.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT bad AS kept
FROM m JOIN b USING (doc_id)
"""
