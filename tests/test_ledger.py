"""Appends by a key ledger, and rows taken from files without moving them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framescore.sources import folders, ledger, selected
from framescore.sources.ledger import KeyLedger


def write(spark, path, rows, files=3):
    made = spark.createDataFrame(rows, "name string, path string, image binary")
    made.repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


def rows_of(names, folder="a"):
    return [(n, f"{folder}/{n}", f"{folder} {n}".encode()) for n in names]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_appends_take_each_key_once(spark, tmp_path):
    store = KeyLedger(spark, str(tmp_path / "store"), "name", buckets=4, capacity=1000)
    assert store.read() is None
    first = write(spark, tmp_path / "one", rows_of([f"n{i}" for i in range(200)]) + rows_of(["n1", "n2"], "A"))
    assert store.append(first, ["path"]) == 200
    assert store.append(first, ["path"]) == 0
    second = write(spark, tmp_path / "two", rows_of([f"n{i}" for i in range(150, 400)], "b") + [(None, "c/1", b"x"), (None, "c/0", b"y")])
    assert store.append(second, ["path"]) == 201
    assert store.append(second, ["path"]) == 0
    got = {r.name: (r.path, bytes(r.image)) for r in store.read().collect()}
    assert store.read().count() == 401 and store.read().columns == ["name", "path", "image"]
    # The first in order of equal names, and one row without a name.
    assert got["n1"] == ("A/n1", b"A n1") and got["n160"] == ("a/n160", b"a n160") and got["n399"] == ("b/n399", b"b n399")
    assert got[None] == ("c/0", b"y")
    # Another session finds the same by its files.
    again = KeyLedger(spark, str(tmp_path / "store"), "name")
    assert again.buckets == 4 and again.keys().count() == 401


def test_the_ledger_is_not_shuffled_and_the_rows_are_not_read(spark, tmp_path):
    store = KeyLedger(spark, str(tmp_path / "store"), "name", buckets=4)
    source = write(spark, tmp_path / "one", rows_of([f"n{i}" for i in range(100)]))
    store.append(source, ["path"])
    marks = spark.range(50).select(ledger.key_mark(F.concat(F.lit("n"), "id")).alias("mark"), F.lit("f").alias("_file"), F.lit(1).alias("_row"))
    decided = store.new_keys(marks)
    assert decided.count() == 0
    assert not any("/rows/" in f for f in decided.inputFiles()) and any("/keys/" in f for f in decided.inputFiles())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(store._unknown(marks))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One exchange, of the few candidates; the bucketed side has none.
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    ledger_side = text[: text.index("Bucketed: true")].rsplit("\n", 1)[0]
    assert "Exchange" not in ledger_side.splitlines()[-1]


def test_pixels_are_not_shuffled(spark, tmp_path):
    source = write(spark, tmp_path / "one", rows_of([f"n{i}" for i in range(100)]))
    places = selected.with_places(source).where("name LIKE '%7'").select("_file", "_row")
    places.write.parquet(str(tmp_path / "places"))
    places = spark.read.parquet(str(tmp_path / "places"))
    taken = list(selected.take_rows(source, places))
    assert len(taken) == 1 and {r.name for r in taken[0].collect()} == {f"n{i}" for i in range(7, 100, 10)}
    for line in plan(taken[0]).splitlines():
        assert "image" not in line or "Exchange" not in line
    # Above the limit the files are taken in several passes.
    several = list(selected.take_rows(source, places, limit=1))
    assert len(several) == 3 and sum(t.count() for t in several) == 10


def test_files_of_many_rows_and_odd_names(spark, tmp_path):
    folder = tmp_path / "with space %20"
    source = write(spark, folder, rows_of([f"n{i:04}" for i in range(1000)]), files=2)
    places = selected.with_places(source).where("crc32(encode(name, 'UTF-8')) % 3 = 0").select("_file", "_row")
    places.write.parquet(str(tmp_path / "p"))
    want = {r.name for r in source.where("crc32(encode(name, 'UTF-8')) % 3 = 0").collect()}
    (taken,) = selected.take_rows(source, spark.read.parquet(str(tmp_path / "p")))
    assert {r.name for r in taken.collect()} == want and len(want) > 200


@pytest.mark.parametrize("step", ["rows", "keys", "rename"])
def test_a_broken_append_leaves_nothing_and_can_be_run_again(spark, tmp_path, monkeypatch, step):
    store = KeyLedger(spark, str(tmp_path / "store"), "name", buckets=2)
    store.append(write(spark, tmp_path / "one", rows_of(["a", "b"])), ["path"])
    source = write(spark, tmp_path / "two", rows_of(["b", "c", "d"], "z"))

    def fails(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        if step == "rows":
            patch.setattr(ledger, "take_rows", fails)
        elif step == "keys":
            patch.setattr(ledger, "bloom_word", fails)
        else:
            patch.setattr(folders, "rename", fails)
        with pytest.raises(RuntimeError):
            store.append(source, ["path"], batch="b7")
    assert {r.name for r in store.read().collect()} == {"a", "b"} and store.keys().count() == 2
    store.clear_broken()
    assert store.append(source, ["path"], batch="b7") == 2
    assert store.append(source, ["path"], batch="b7") == 0
    assert sorted(r.name for r in store.read().collect()) == ["a", "b", "c", "d"]


def test_a_full_filter_changes_no_result(spark, tmp_path):
    store = KeyLedger(spark, str(tmp_path / "store"), "name", buckets=2, capacity=4)
    source = write(spark, tmp_path / "one", rows_of([f"n{i}" for i in range(300)]))
    more = write(spark, tmp_path / "two", rows_of([f"n{i}" for i in range(250, 600)]))
    assert store.append(source, ["path"]) == 300 and store.append(more, ["path"]) == 300
    assert store.read().select("name").distinct().count() == 600


def test_the_filter_says_surely_new_of_most_new_keys(spark, tmp_path):
    store = KeyLedger(spark, str(tmp_path / "store"), "name", capacity=2000)
    store.append(write(spark, tmp_path / "one", rows_of([f"n{i}" for i in range(2000)])), ["path"])
    fresh = spark.range(5000).select(ledger.key_mark(F.concat(F.lit("m"), "id")).alias("mark"))
    bits = ledger.bloom_bits(F.col("mark"))
    tested = fresh.withColumn("word", ledger.bloom_word(F.col("mark"), store.words)).join(store.bloom(), "word", "left")
    assert tested.where(F.col("bits").bitwiseAND(bits) == bits).count() < 5000 * 0.04


def test_the_key_of_a_table_is_fixed(spark, tmp_path):
    KeyLedger(spark, str(tmp_path / "store"), "name")
    with pytest.raises(ValueError):
        KeyLedger(spark, str(tmp_path / "store"), "path")
