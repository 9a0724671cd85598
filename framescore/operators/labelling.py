"""Labelling images with an external labeller, one failure at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.functions.jsonio import is_json, label_reply, normalised_label
from framescore.functions.names import stem
from framescore.functions.staging import compute_once
from framescore.schema import LABEL_REPLIES, LABELS, validate

NOT_JSON = "reply is not JSON"


def label_images(images: DataFrame, labeller: Callable[[bytes], str], parallelism: int | None = None) -> DataFrame:
    """``name, raw, ok, error`` for each image in ``name, content``.

    A call that fails costs its own row only. ``parallelism`` bounds the calls that
    run at once, for services with a rate limit.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    out.append((name, labeller(bytes(content)), True, None))
                except Exception as e:  # noqa: BLE001  any failure is a result here
                    out.append((name, None, False, str(e)))
            yield pd.DataFrame(out, columns=LABEL_REPLIES.names)

    rows = images.select("name", "content")
    if parallelism:
        rows = rows.coalesce(parallelism)
    return rows.mapInPandas(call, LABEL_REPLIES)


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies with their parsed label; a reply that is not JSON turns ``ok`` off."""
    parsed = compute_once(replies, "_reply", label_reply(F.col("raw")))
    ok = F.col("ok") & is_json(F.col("_reply"))
    reason = F.coalesce(F.col("error"), F.when(~ok, F.lit(NOT_JSON)))
    return parsed.select(
        stem(F.col("name")).alias("image_name"), normalised_label(F.col("_reply")).alias("label"),
        F.col("_reply.notes").alias("notes"), ok.alias("ok"), reason.alias("error"),
    )


def normalise_labels(df: DataFrame) -> DataFrame:
    """Labeller output as ``image_name, label, notes``, whichever label key it used."""
    if "animal" in df.columns:
        label = F.coalesce(F.col("label"), F.col("animal")) if "label" in df.columns else F.col("animal")
        df = df.withColumn("label", label)
    return validate(df, LABELS)


def label_summary(parsed: DataFrame) -> DataFrame:
    """Images labelled and failed."""
    return parsed.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def failed_images(parsed: DataFrame) -> DataFrame:
    """The failed images as rows, since there may be many."""
    return parsed.where(~F.col("ok")).select("image_name", "error")
