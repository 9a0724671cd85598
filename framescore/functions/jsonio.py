"""Base64, label replies, score requests and score replies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescore.functions.grid import let

# The fence around a JSON reply and the shapes of the messages.
FENCE_START = "```json"
FENCE = r"(?s)```json\s*(.*?)\s*```"
DATA_URL = "data:image/jpeg;base64,"
REPLY_SCHEMA = "animal string, label string, notes string, _corrupt_record string"
PREDICTIONS_SCHEMA = "predictions array<array<double>>"
INSTANCES_SCHEMA = "instances array<array<array<array<double>>>>"
TENSOR_SCHEMA = (
    "inputs struct<tensor: struct<`shape`: array<int>, `values`: array<double>>>"
)


def data_url(content: Column) -> Column:
    """Image bytes as the URL a vision service takes, without Spark's line breaks."""
    return F.concat(F.lit(DATA_URL), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def fenced_json(reply: Column) -> Column:
    """The JSON text in a reply: what its first ``json`` fence holds, else all of it."""
    fenced = reply.contains(FENCE_START) & reply.rlike(FENCE)
    return F.when(fenced, F.regexp_extract(reply, FENCE, 1)).otherwise(F.btrim(reply, F.lit(" \t\n\r\f\v")))


def label_reply(reply: Column) -> Column:
    """A reply as ``struct<animal, label, notes, _corrupt_record>``; the last is null for good JSON."""
    return F.from_json(fenced_json(reply), REPLY_SCHEMA, {"allowSingleQuotes": "false"})


def is_json(parsed: Column) -> Column:
    """Whether a parsed reply was JSON at all."""
    return parsed.isNotNull() & parsed["_corrupt_record"].isNull()


def normalised_label(parsed: Column) -> Column:
    """The label of a parsed reply, under either of the two keys labellers use."""
    return F.coalesce(parsed["label"], parsed["animal"])


def nested(values: Column, shape: list[int]) -> Column:
    """A flat array as arrays in arrays: ``[3, 224, 224]`` gives 3 of 224 of 224."""
    def level(flat: Column, dims: list[int], start: Column) -> Column:
        if len(dims) == 1:
            return F.slice(flat, start + 1, F.lit(dims[0]))
        block = math.prod(dims[1:])
        positions = F.sequence(F.lit(0), F.lit(dims[0] - 1))
        return F.transform(positions, lambda i: level(flat, dims[1:], start + i * block))

    return let(values, lambda flat: level(flat, shape, F.lit(0)))


def instances_request(values: Column, shape: list[int]) -> Column:
    """``{"instances": [[[[…]]]]}`` with one instance of ``shape``."""
    return F.to_json(F.struct(F.array(nested(values, shape)).alias("instances")))


def tensor_request(values: Column, shape: list[int]) -> Column:
    """``{"inputs": {"tensor": {"shape": […], "values": […]}}}``, the batch axis first."""
    dims = F.array(F.lit(1), *[F.lit(d) for d in shape])
    tensor = F.struct(dims.alias("shape"), values.alias("values"))
    return F.to_json(F.struct(F.struct(tensor.alias("tensor")).alias("inputs")))


def explode_predictions(replies: DataFrame, body: Column) -> DataFrame:
    """One row per prediction of each reply: ``position`` from 0, ``logits``.

    A reply without predictions, or one that is not JSON, stays as one row with nulls.
    """
    predictions = F.from_json(body, PREDICTIONS_SCHEMA)["predictions"]
    return replies.select("*", F.posexplode_outer(predictions).alias("position", "logits"))
