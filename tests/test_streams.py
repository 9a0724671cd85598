"""Streams with keyed state: appends, strides; and joins with bucketed tables."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from framescore.operators import combine, sampling
from framescore.sources.bucketed import drop_bucketed, read_bucketed, write_bucketed
from framescore.sources.ledger import KeyLedger
from framescore.streaming import stride
from framescore.streaming.append import PROVIDER, append_keyed_stream, state_on_disk
from framescore.streaming.score import stream_table, write_stream
from framescore.streaming.stride import stride_stream


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _add(spark, folder, rows, schema="name string, path string, image binary"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def _rows(numbers, folder):
    return [(f"n{i}", f"{folder}/{i}", b"pixels") for i in numbers]


def test_stream_appends_each_key_once_and_reads_no_stored_row(spark, tmp_path, monkeypatch):
    folder, store = f"{tmp_path}/in", KeyLedger(spark, f"{tmp_path}/store", "name", buckets=2)
    spark.createDataFrame(_rows(range(5), "before"), "name string, path string, image binary").write.parquet(f"{tmp_path}/old")
    store.append(spark.read.parquet(f"{tmp_path}/old"), ["path"])
    read = []
    monkeypatch.setattr(store, "read", lambda: read.append("rows"))
    asked, known = [], store.new_keys

    def new_keys(marks):
        out = known(marks)
        asked.append((marks.count(), out.inputFiles()))
        return out

    monkeypatch.setattr(store, "new_keys", new_keys)
    for part in (range(10), range(8, 20), range(20)):
        _add(spark, folder, _rows(part, "in"))
    append_keyed_stream(spark, folder, store, f"{tmp_path}/progress", files_per_batch=1).awaitTermination()
    # State lets only keys through that the stream has not had: no key is asked for twice.
    assert sum(n for n, _ in asked) == 20 and len(asked) >= 3
    assert not read and not any("/rows/" in f for _, files in asked for f in files)
    assert spark.conf.get(PROVIDER) != "" and "RocksDB" not in spark.conf.get(PROVIDER)
    # A restart finds nothing new; new files after it are taken.
    append_keyed_stream(spark, folder, store, f"{tmp_path}/progress", files_per_batch=1).awaitTermination()
    _add(spark, folder, _rows(range(15, 25), "late"))
    append_keyed_stream(spark, folder, store, f"{tmp_path}/progress", files_per_batch=1).awaitTermination()
    monkeypatch.undo()
    rows = {r.name: r.path for r in store.read().collect()}
    assert store.read().count() == 25 and set(rows) == {f"n{i}" for i in range(25)}
    assert rows["n3"] == "before/3" and rows["n24"] == "late/24"


def test_another_stream_over_the_same_files_adds_nothing(spark, tmp_path):
    folder, store = f"{tmp_path}/in", KeyLedger(spark, f"{tmp_path}/store", "name", buckets=2)
    _add(spark, folder, _rows([1, 1, 2, 3], "in"))
    for progress in ("p1", "p2"):
        append_keyed_stream(spark, folder, store, f"{tmp_path}/{progress}").awaitTermination()
    assert sorted(r.name for r in store.read().collect()) == ["n1", "n2", "n3"]


def test_state_that_forgets_still_appends_each_key_once(spark, tmp_path):
    folder, store = f"{tmp_path}/in", KeyLedger(spark, f"{tmp_path}/store", "name", buckets=2)
    for day in (1, 2, 3):
        rows = [(f"n{i}", f"in/{day}/{i}") for i in range(day)]
        made = spark.createDataFrame(rows, "name string, path string").withColumn("taken", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
        made.coalesce(1).write.mode("append").parquet(folder)
    append_keyed_stream(spark, folder, store, f"{tmp_path}/p", 1, "taken", "1 hour").awaitTermination()
    assert sorted(r.name for r in store.read().collect()) == ["n0", "n1", "n2"]


FRAMES = "source string, at int, no int"


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_stride_equals_the_batch_for_any_split(spark, tmp_path, pieces):
    r = random.Random(pieces)
    rows = sorted(((f"s{r.randrange(4)}", i, i * 7) for i in range(120)), key=lambda x: x[1])
    cuts = sorted(r.sample(range(1, 120), pieces - 1))
    for lo, hi in zip([0, *cuts], [*cuts, 120]):
        own = rows[lo:hi]
        r.shuffle(own)
        _add(spark, f"{tmp_path}/in", own, FRAMES)
    stream = stream_table(spark, f"{tmp_path}/in", 1)
    with state_on_disk(spark):
        write_stream(stride_stream(stream, "source", ["at", "no"], 5), f"{tmp_path}/out", f"{tmp_path}/p").awaitTermination()
    want = sampling.stride_sample(spark.createDataFrame(rows, FRAMES), "source", ["at", "no"], 5)
    columns = ["source", "at", "no", "frame_no", "frame_name"]
    got = spark.read.parquet(f"{tmp_path}/out").select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(columns).collect()))


def test_sources_of_one_bucket_keep_counts_of_their_own_in_one_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stride, "BUCKETS", 2)
    # Whole numbers beyond those that a float holds, beside rows without a source.
    rows = [(s, i, i) for i in range(24) for s in (2**60 + 1, 2**60 + 2, 5, None, 9)]
    frames = "source bigint, at int, no int"
    for lo, hi in ((0, 33), (33, 70), (70, 120)):
        _add(spark, f"{tmp_path}/in", rows[lo:hi], frames)
    with state_on_disk(spark):
        kept = stride_stream(stream_table(spark, f"{tmp_path}/in", 1), "source", ["at"], 5)
        write_stream(kept, f"{tmp_path}/out", f"{tmp_path}/p").awaitTermination()
        keys = spark.read.format("statestore").option("stateVarName", "seen").load(f"{tmp_path}/p").count()
    assert 1 < keys <= 3
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("source", "at", "frame_no").collect()]
    assert sorted(got, key=str) == sorted([(s, i, i // 5 + 1) for s, i, _ in rows if i % 5 == 0], key=str)


def test_an_idle_source_ends_and_begins_anew(spark, tmp_path):
    _add(spark, f"{tmp_path}/in", [("a", 0, 0), ("a", 1, 1)], FRAMES)
    stream = stream_table(spark, f"{tmp_path}/in", 1)
    with state_on_disk(spark):
        kept = stride_stream(stream, "source", ["at"], 3, idle_ms=2000)
        writer = kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/p")
        query = writer.trigger(processingTime="500 milliseconds").start()

    def wait_for(n):
        end = time.time() + 40
        while time.time() < end:
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = sorted((r.source, r.no, r.frame_no) for r in spark.read.schema("source string, at int, no int, frame_no bigint").parquet(f"{tmp_path}/out").collect())
                if len(got) >= n:
                    return got
            time.sleep(0.5)
        raise AssertionError("no result")

    try:
        assert wait_for(1) == [("a", 0, 1)]
        time.sleep(8)
        _add(spark, f"{tmp_path}/in", [("a", 2, 2), ("a", 3, 3)], FRAMES)
        assert wait_for(2) == [("a", 0, 1), ("a", 2, 1)]
    finally:
        query.stop()


def test_bucketed_label_join_moves_labels_only(spark, tmp_path):
    images = spark.createDataFrame([(f"f/n{i}.jpg", f"n{i}", b"pixels") for i in range(200)], "name string, stem string, image binary")
    labels = spark.createDataFrame([(f"n{i}", i % 2) for i in range(0, 250, 3)] + [("n0", 7)], "image_name string, label int")
    path = f"{tmp_path}/images"
    write_bucketed(images, path, "stem", 4)
    # As another session would find it.
    drop_bucketed(spark, path)
    stored = read_bucketed(spark, path)
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        text = plan(combine.join_labels(stored, labels))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    assert not any("Exchange" in line and "image#" in line for line in text.splitlines())
    got = combine.join_labels(stored, labels).select("name", "label").collect()
    want = combine.join_labels(images.drop("stem"), labels).select("name", "label").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 201
    # Written anew, it is read anew.
    write_bucketed(images.limit(3), path, "stem", 2)
    assert read_bucketed(spark, path).count() == 3
