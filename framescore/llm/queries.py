"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.llm import chat, editembed, hostrules, htmltext, katz, minhash, mixing, packing, passages, prefixtrie, runs, sharding, tokencounts
from framescore.llm.scratch import Scratch
from framescore.session import new_shared_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return run


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_repeated_passages(spark, sf_dir):
    """Passages of 50 words and more that an earlier document holds too, with both word spans."""
    return passages.passages(_read(spark, sf_dir, "documents"), Scratch(spark, "op1"))


@_query
def op2_kd_shards(spark, sf_dir):
    """24 shards of near-equal bytes, cut along source, language and length."""
    scratch = Scratch(spark, "op2")
    shards = scratch.write(sharding.kd_shards(_read(spark, sf_dir, "documents"), scratch, n_shards=24), "shards")
    placed = sharding.with_slots(shards, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op3_differenced_packing(spark, sf_dir):
    """All token ids in sequences of at most 2,048."""
    return packing.pack(packing.cut_pieces(_read(spark, sf_dir, "documents")))


@_query
def op4_rendered_chats(spark, sf_dir):
    """All conversations formatted, and read back from the output."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn int, role string, text string")
    rows = turns.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in turns.schema]))
    return chat.digests(chat.format_chats(rows)).drop("rewrites_history")


@_query
def op5_host_rules(spark, sf_dir):
    """Base measures of every document, and the verdict of rules and hosts."""
    return hostrules.judge(_read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


@_query
def op6_edit_fingerprints(spark, sf_dir):
    """Fingerprints of every text and of its edited text."""
    return editembed.next_digests(_read(spark, sf_dir, "documents"))


@_query
def op7_main_text(spark, sf_dir):
    """The main text of every page."""
    return htmltext.extract(_read(spark, sf_dir, "pages"))


@_query
def op8_water_filled_mix(spark, sf_dir):
    """What a mix of 150 % of all words takes of each document."""
    scratch = Scratch(spark, "op8")
    rows = scratch.write(mixing.sized(_read(spark, sf_dir, "documents")), "sizes")
    targets = scratch.write(mixing.source_targets(rows), "targets")
    return mixing.take(rows, targets).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_token_rollup(spark, sf_dir):
    """Token totals after four commits: all documents in, one of them sent twice; later copies of a text out;
    what is left recounted by another tokenizer version, language by language, English first.
    """
    scratch = Scratch(spark, "op9")
    docs = _read(spark, sf_dir, "documents")
    counts = scratch.write(tokencounts.count_tokens(docs.select("doc_id", "source", "lang", "text", F.md5("text").alias("hash"))), "counts")
    firsts = counts.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND hash IS NOT NULL")
    firsts = scratch.write(firsts.select(F.col("hash").alias("h"), "first"), "firsts")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = counts.join(firsts, F.col("hash") == F.col("h"), "left").withColumn("copy", later)
    rollup = tokencounts.Rollup(spark, new_shared_path(spark, "rollup"))
    rollup.commit("0001-insert", tokencounts.inserts(counts, "words", "words"))
    rollup.commit("0001-insert", tokencounts.inserts(counts, "words", "words"))
    rollup.commit("0002-copies", tokencounts.deletes(marked.where("copy"), "words", "words"))
    left = marked.where("NOT copy")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for name, part in (("0003-english", english), ("0004-others", ~english)):
        rollup.commit(name, tokencounts.revisions(left.where(part), "words", "words", "word_bpe_49k", "bpe_tokens"))
    return rollup.totals()


@_query
def op10_near_duplicates(spark, sf_dir):
    """The near-duplicate class of every document."""
    return minhash.classes(_read(spark, sf_dir, "documents"), Scratch(spark, "op10"))


@_query
def op11_prefix_trie(spark, sf_dir):
    """The trie of rebuilt conversations, with leaves and savings of every subtree."""
    return prefixtrie.trie(prefixtrie.rebuilt(_read(spark, sf_dir, "conversations")), Scratch(spark, "op11"))


@_query
def op12_katz_scores(spark, sf_dir):
    """Every document's probability by a backoff model of six in seven documents, and by a smoothed unigram base."""
    model = katz.Katz(_read(spark, sf_dir, "documents"), katz.held_out(), Scratch(spark, "op12"))
    # Rounded to 1e-6, far above what the order of summing changes.
    return model.scores().withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@_query
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of every document's words, and digests of its text with runs cut to one period."""
    return runs.digests(_read(spark, sf_dir, "documents"))


ORACLES["op5_host_rules"] = hostrules.ORACLE
ORACLES["op8_water_filled_mix"] = mixing.ORACLE
ORACLES["op11_prefix_trie"] = prefixtrie.ORACLE
ORACLES["op12_katz_scores"] = katz.ORACLE
