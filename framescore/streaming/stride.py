"""Every n-th frame of each source, on a live stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framescore.functions.names import frame_name


# Sources are dealt to so many buckets, whose counts are one value of the state. It is part of a checkpoint's meaning: do not change it.
BUCKETS = 4096


class _Stride(StatefulProcessor):
    """Per bucket of sources: how many frames of each have come, and when it was heard of last."""

    def __init__(self, source: str, order: list[str], names: list[str], step: int, idle_ms: int | None):
        self.source, self.order, self.names, self.step, self.idle_ms = source, order, names, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "source array<string>, n array<bigint>, heard array<bigint>")

    def _known(self) -> dict:
        return {s: (n, at) for s, n, at in zip(*self.seen.get())} if self.seen.exists() else {}

    def _keep(self, known: dict) -> None:
        self.seen.update(([*known], [n for n, _ in known.values()], [at for _, at in known.values()]))
        if self.idle_ms is not None:
            # One timer per bucket: that of the source heard of least lately.
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(min(at for _, at in known.values()) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self._known()
        code, names = pd.factorize(frames[self.source], use_na_sentinel=False)
        names = [str(s) for s in names]
        own = frames.groupby(code, sort=False).cumcount().to_numpy()
        place = np.array([known.get(s, (0, 0))[0] for s in names])[code] + own
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        came = np.zeros(len(names), np.int64)
        np.maximum.at(came, code, place + 1)
        self._keep(known | {s: (n, now) for s, n in zip(names, came.tolist())})
        taken = place % self.step == 0
        kept = frames[taken][self.names].copy()
        kept["frame_no"] = place[taken] // self.step + 1
        if len(kept):
            yield kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Sources not heard of for so long are over: the next frame, if one comes, is the first of another recording.
        end = expiredTimerInfo.getExpiryTimeInMs() - self.idle_ms
        left = {s: (n, at) for s, (n, at) in self._known().items() if at > end}
        if left:
            self._keep(left)
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def stride_stream(frames: DataFrame, source: str, order: list[str], step: int, idle_ms: int | None = None) -> DataFrame:
    """``stride_sample`` of a stream: every ``step``-th row of each source, numbered from 1.

    A source's frames come in order from micro-batch to micro-batch; inside one they are sorted here. State is two numbers per
    source. It is read and written by bucket, so the calls to the state do not grow with the sources; a micro-batch costs what it
    brings and the counts of its buckets. A source without frames for ``idle_ms`` milliseconds is over, and its state goes;
    its timers keep such a query awake, so it runs until it is stopped.
    Run it on narrow rows: frames of a bucket are dealt to its task.
    """
    names, kind = frames.columns, frames.schema[source].dataType
    if isinstance(kind, T.IntegralType):
        # As text: beside rows without a source, pandas turns whole numbers into floats.
        frames = frames.withColumn(source, F.col(source).cast("string"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frames.schema)
    bucket = F.when(F.col(source).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(source), F.lit(BUCKETS)))
    kept = frames.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        _Stride(source, order, names, max(1, step), idle_ms), f"{kinds}frame_no bigint", "Append", "processingTime" if idle_ms is not None else "None"
    )
    return kept.withColumn(source, F.col(source).cast(kind)).withColumn("frame_name", frame_name(F.col("frame_no")))
