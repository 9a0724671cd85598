"""Sources, sinks, joins, duplicates, rankings and balance."""

from __future__ import annotations

import json
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pictures import arrays, noise, ramp, table, write_png
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framescore.functions import names
from framescore.operators import combine, labelling, pixels, ranking, runlog, sampling
from framescore.plans.dataset import noisy_images
from framescore.plans.labelling import label_folder
from framescore.schema import FILES, LABELS, SchemaError, validate
from framescore.session import build_session, cut_lineage, shared_dir
from framescore.sources import images, labels, tables


@pytest.fixture
def folder(tmp_path):
    write_png(tmp_path / "images" / "frame_001.png", ramp())
    write_png(tmp_path / "images" / "frame_002.png", noise(30, 20))
    write_png(tmp_path / "images" / "grey.png", noise(8, 8, 1))
    write_png(tmp_path / "images" / "clear.png", noise(8, 8, 4))
    (tmp_path / "images" / "broken.png").write_bytes((tmp_path / "images" / "grey.png").read_bytes()[:40])
    (tmp_path / "images" / "readme.txt").write_text("no image")
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "My_Labels.CSV").write_text(
        '"image_name","label","notes"\n"frame_001","swan","calm, ""left"""\n"frame_001","swan","again"\n'
        '"absent","swan",""\n'
    )
    return tmp_path


def test_listing(spark, folder):
    listing = images.list_images(spark, f"{folder}/images")
    names = [r.name for r in images.require_images(listing, "images").collect()]
    assert names == ["broken.png", "clear.png", "frame_001.png", "frame_002.png", "grey.png"]
    assert validate(listing, FILES).columns == ["name", "path"]
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_empty_listing_is_an_error(spark, folder):
    listing = images.list_images(spark, f"{folder}/labels")
    with pytest.raises(FileNotFoundError):
        images.require_images(listing, "labels")


def test_decoding(spark, folder):
    found = images.read_images(spark, f"{folder}/images")
    assert [r.name for r in images.rejects(found).collect()] == ["broken.png"]
    good = {r.name: r.image for r in images.valid(found).collect()}
    assert {n: (i.height, i.width, i.nChannels) for n, i in good.items()} == {
        "frame_001.png": (6, 9, 3), "frame_002.png": (30, 20, 3), "grey.png": (8, 8, 1), "clear.png": (8, 8, 4),
    }
    first = np.frombuffer(bytes(good["frame_001.png"].data), np.uint8).reshape(6, 9, 3)
    assert (first[..., ::-1] == ramp()).all()


def test_png_export_reads_back(spark, folder, tmp_path):
    good = images.valid(images.read_images(spark, f"{folder}/images"))
    for row in good.select("name", pixels.encode_png(F.col("image")).alias("png")).collect():
        (tmp_path / "out").mkdir(exist_ok=True)
        (tmp_path / "out" / row.name).write_bytes(bytes(row.png))
    again = images.read_images(spark, f"{tmp_path}/out").select("name", F.col("image.data").alias("b"))
    assert good.select("name", F.col("image.data").alias("a")).join(again, "name").where("a = b").count() == 4


def test_label_file(spark, folder):
    path = labels.find_label_file(spark, f"{folder}/labels")
    assert path.endswith("My_Labels.CSV")
    rows = labels.read_labels(spark, path).collect()
    assert len(rows) == 3 and rows[0].notes == 'calm, "left"'
    with pytest.raises(FileNotFoundError):
        labels.find_label_file(spark, f"{folder}/images")


def test_label_header_is_checked(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('"image","label","notes"\n"a","b","c"\n')
    with pytest.raises(Exception, match="header does not conform"):
        labels.read_labels(spark, f"{tmp_path}/labels.csv").collect()


def test_label_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "swan", 'x "y", z'), ("b", "swan", "")], LABELS).coalesce(1)
    for _ in range(2):
        labels.write_labels_csv(rows, f"{tmp_path}/csv")
        labels.write_labels_json(rows, f"{tmp_path}/json")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == '"image_name","label","notes"' and text[1].startswith('"a","swan",')
    assert text[1] == '"a","swan","x ""y"", z"'
    assert labels.read_labels(spark, f"{tmp_path}/csv").first().notes == 'x "y", z'
    assert spark.read.schema(LABELS).json(f"{tmp_path}/json").count() == 2
    document = {"a": {"animal": "swan", "notes": "n"}, "b": {"label": "duck", "notes": "m"}}
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=4))
    got = {tuple(r) for r in labels.read_label_documents(spark, f"{tmp_path}/doc.json").collect()}
    assert got == {("a", "swan", "n"), ("b", "duck", "m")}


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "image_name string, label string")


def test_join_keeps_unlabelled_images_and_repeats_duplicates(spark):
    listing = spark.createDataFrame([("a.jpg", "old"), ("b.jpg", "old"), ("c.jpg", "old")], "name string, label string")
    found = label_rows(spark, [("a", "swan"), ("a", "duck"), ("x", "swan")])
    for joined in (
        combine.join_labels(listing, found),
        combine.join_labels(listing, found, salt_by=F.col("name"), salts=3),
    ):
        assert sorted(map(tuple, joined.collect()), key=str) == [
            ("a.jpg", "duck"), ("a.jpg", "swan"), ("b.jpg", None), ("c.jpg", None),
        ]


def hot_images(spark, n=6000):
    """A third of all rows share one name."""
    name = F.when(F.col("id") % 3 == 0, "hot.jpg").otherwise(F.concat(F.lit("i"), "id", F.lit(".jpg")))
    return spark.range(n).select(name.alias("name"), F.concat(F.lit("p"), "id").alias("path"))


def test_hot_name_in_label_join_and_counts(spark):
    listing = hot_images(spark)
    found = label_rows(spark, [("hot", "swan"), ("i1", "duck"), ("hot", "goose")])
    plain = combine.join_labels(listing, found)
    salted = combine.join_labels(listing, found, salt_by=F.col("path"))
    expected = {"swan": 2000, "goose": 2000, "duck": 1, None: 3999}
    for rows in (plain.groupBy("label").agg(F.count("*").alias("n")),
                 salted.groupBy("label").agg(F.count("*").alias("n")), combine.label_counts(listing, found)):
        assert {r.label: r.n for r in rows.collect()} == expected


def test_hot_name_is_split_at_run_time(spark, tmp_path):
    hot_images(spark, 60000).repartition(4).write.parquet(f"{tmp_path}/images")
    listing = spark.read.parquet(f"{tmp_path}/images")
    found = label_rows(spark, [("hot", "swan"), ("i1", "duck")])
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = combine.join_labels(listing, found)
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 60000
    assert "skew=true" in plan


def test_dedup_keeps_the_least_row(spark):
    rows = [("a", "p2", 1), ("a", "p1", 2), ("a", "p1", 1), ("b", None, 5), ("b", "q", 1)]
    df = spark.createDataFrame(rows, "name string, path string, n int")
    got = {tuple(r) for r in combine.dedup(df, "name", ["path"]).collect()}
    assert got == {("a", "p1", 1), ("b", None, 5)}


def test_dedup_shuffles_one_row_per_key_and_task(spark):
    plan = combine.dedup(hot_images(spark), "name", ["path"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning(name")


def test_append_is_rerunnable(spark, tmp_path):
    first = hot_images(spark, 300)
    path = f"{tmp_path}/t"
    tables.write_table(combine.dedup(first, "name", ["path"]).limit(10), path)
    for _ in range(2):
        tables.append_new(spark, first, path, "name", ["path"])
    got = tables.read_table(spark, path, FILES)
    assert got.count() == got.select("name").distinct().count() == 201


def test_append_handles_missing_order_values(spark):
    incoming = spark.createDataFrame([("a", None), ("b", "x"), ("c", None)], "name string, path string")
    known = spark.createDataFrame([("c",)], "name string")
    assert {r.name for r in combine.only_new(incoming, known, "name", ["path"]).collect()} == {"a", "b"}


def test_union_by_name(spark):
    a = spark.createDataFrame([("n", "p")], "name string, path string")
    b = spark.createDataFrame([("q", "m")], "path string, name string")
    assert {tuple(r) for r in combine.union_all([a, b]).collect()} == {("n", "p"), ("m", "q")}
    assert combine.union_all([a, a.drop("path")], allow_missing=True).where("path is null").count() == 1


def test_rank_of_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("source"),
        (F.col("id") * 7919 % 5003).alias("ts"), "id",
    )
    ranked = ranking.exact_rank(df, ["source"], ["ts", "id"]).toPandas()
    expected = ranked.sort_values(["source", "ts", "id"]).groupby("source").cumcount() + 1
    assert (ranked["rank"] == expected.sort_index()).all() and len(ranked) == 5000


def test_rank_spreads_one_group_over_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id"))
    ranked = ranking.exact_rank(df, ["g"], ["id"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 4001))


def test_rank_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (7, 2)], "g int, id int")
    got = {tuple(r) for r in ranking.exact_rank(df, ["g"], ["id"]).collect()}
    assert got == {(None, 1, 1), (None, 3, 2), (7, 2, 1)}


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, id int")
    assert ranking.exact_rank(empty, ["g"], ["id"]).count() == 0


def test_hash_split_is_stable_and_about_a_fifth(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name"))
    a = {r.name: r.split for r in sampling.hash_split(df).collect()}
    b = {r.name: r.split for r in sampling.hash_split(df.repartition(7)).collect()}
    assert a == b
    assert 850 < sum(s == "eval" for s in a.values()) < 1150


def classes(spark, normal=18, abnormal=7):
    label = F.when(F.col("id") < normal, 1).otherwise(0)
    return spark.range(normal + abnormal).select(F.concat(F.lit("n"), "id", F.lit(".jpg")).alias("name"), label.alias("label"))


def test_balance_to_targets(spark):
    rows = sampling.balance_classes(classes(spark))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 44 * 18, 0: 28 * 7}
    assert rows.select("name").distinct().count() == sum(counts.values())
    assert {r.name for r in rows.where("source_name = 'n0.jpg' and variant < 2").collect()} == {"n0_tr0.jpg", "n0_tr1.jpg"}


def test_balance_exactly(spark):
    rows = sampling.balance_classes(classes(spark), exact=True)
    assert {r.label: r["count"] for r in rows.groupBy("label").count().collect()} == {1: 800, 0: 200}


def test_balance_with_originals(spark):
    rows = sampling.balance_classes(classes(spark), include_original=True)
    assert rows.where("variant = -1 and name = source_name").count() == 25
    assert rows.count() == 44 * 18 + 28 * 7 + 25


def test_class_at_its_target_keeps_its_rows_once(spark):
    rows = sampling.balance_classes(classes(spark, normal=900))
    assert rows.where("label = 1").count() == 900


def test_empty_class_is_named(spark):
    with pytest.raises(PySparkException, match="no rows of class 0"):
        sampling.balance_classes(classes(spark, abnormal=0)).count()


def test_stride(spark):
    df = spark.range(95).select(F.lit("v").alias("source"), F.col("id").alias("ts"))
    kept = sampling.stride_sample(df, "source", ["ts"], sampling.frame_step(F.lit(5.0)))
    assert [(r.ts, r.frame_name) for r in kept.orderBy("ts").collect()] == [
        (10 * i, f"frame_{i + 1:03d}.jpg") for i in range(10)
    ]
    assert spark.range(1).select(sampling.frame_step(F.lit(0.1))).first()[0] == 1
    assert spark.range(1).select(sampling.frame_step(F.lit(1.25))).first()[0] == 2  # 2.5 to even


def test_labelling_records_failures(spark):
    files = spark.createDataFrame(
        [("a.jpg", b"1"), ("b.jpg", b"2"), ("c.jpg", b"3"), ("d.v2.jpg", b"4"), ("e.jpg", b"5")], "name string, content binary"
    )

    def labeller(content: bytes) -> str:
        if content == b"1":
            raise RuntimeError("429")
        if content == b"2":
            return "cannot tell"
        if content == b"5":
            return '{"notes": "empty water"}'
        return '```json\n{"animal": "swan", "notes": "n%s"}\n```' % content.decode()

    parsed = labelling.parse_replies(labelling.label_images(files, labeller, parallelism=2))
    got = {r.image_name: (r.label, r.notes, r.ok, r.error) for r in parsed.collect()}
    assert got == {
        "a": (None, None, False, "429"), "b": (None, None, False, "reply is not JSON"),
        "c": ("swan", "n3", True, None), "d.v2": ("swan", "n4", True, None),
        "e": (None, "empty water", True, None),
    }
    assert {(r.ok, r.n) for r in labelling.label_summary(parsed).collect()} == {(True, 3), (False, 2)}


def test_label_folder(spark, folder):
    calls = spark.sparkContext.accumulator(0)

    def labeller(content: bytes) -> str:
        calls.add(1)
        if len(content) < 60:
            raise ValueError("too small")
        return '{"animal": "swan", "notes": "seen, \\"well\\""}'

    for _ in range(2):
        failed = label_folder(spark, f"{folder}/images", labeller, f"{folder}/out", parallelism=1)
    assert [tuple(r) for r in failed.collect()] == [("broken", "too small")]
    assert calls.value == 10
    rows = labels.read_labels(spark, f"{folder}/out/csv").collect()
    assert {r.image_name for r in rows} == {"clear", "frame_001", "frame_002", "grey"}
    assert {r.notes for r in rows} == {'seen, "well"'}


def test_noisy_images(spark, folder):
    found = images.valid(images.read_images(spark, f"{folder}/images")).where("image.width = 20")
    row = noisy_images(found, amount=0.2).first()
    assert (row.name, row.path) == ("frame_002_noisy.png", "n/a")
    assert row.image.data != found.first().image.data


def test_jpeg_files_are_decoded(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    for name, kind, channels in (("rgb", 5, 3), ("grey", 10, 1)):  # 3-byte BGR and byte grey
        picture = jvm.java.awt.image.BufferedImage(12, 7, kind)
        assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/{name}.jpg"))
        row = images.read_images(spark, f"{tmp_path}").where(f"name = '{name}.jpg'").first()
        assert (row.image.height, row.image.width, row.image.nChannels) == (7, 12, channels)


def test_undecodable_rows_pass_through(spark):
    df = table(spark, {"a": np.zeros((4, 4, 3), np.uint8)})
    bad = F.struct(F.lit("").alias("origin"), *[F.lit(-1).alias(c) for c in ("height", "width", "nChannels", "mode")], F.lit(b"").alias("data"))
    rows = df.select("name", "image").union(df.select(F.lit("bad"), bad))
    done = {r.name: r for r in rows.select("name", pixels.resize(F.col("image"), 2, 2).alias("i"), pixels.encode_png(F.col("image")).alias("png")).collect()}
    assert done["a"].i.height == 2 and done["bad"].i.height == -1 and done["bad"].png is None


@pytest.mark.parametrize("name, stem", [("a.jpg", "a"), ("b.PNG", "b"), ("c.d.jpeg", "c.d"), ("e", "e")])
def test_labels_and_names_for_any_extension(spark, name, stem):
    listing = spark.createDataFrame([(name,)], "name string")
    known = spark.createDataFrame([(stem, "swan", None)], "image_name string, label string, notes string")
    assert combine.join_labels(listing, known).first().label == "swan"
    end = name[len(stem):]
    made = listing.select(names.with_ending(F.col("name"), "_flipped").alias("f"), names.with_variant(F.col("name"), F.lit(3)).alias("v")).first()
    assert (made.f, made.v) == (f"{stem}_flipped{end}", f"{stem}_tr3{end}")
    again = listing.select(names.root(F.lit(made.f)), names.root(F.lit(made.v)), names.is_flipped(F.lit(made.f))).first()
    assert tuple(again) == (name, name, True)


def test_files_are_listed_in_any_case_and_others_reported(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.Png", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpeg").write_bytes(b"x")
    listed = lambda df: sorted(r.name for r in df.collect())
    assert listed(images.list_images(spark, str(tmp_path))) == ["a.jpg", "b.JPG", "c.Png"]
    assert listed(images.list_images(spark, str(tmp_path), recursive=True)) == ["a.jpg", "b.JPG", "c.Png", "d.jpeg"]
    assert listed(images.other_files(spark, str(tmp_path))) == ["notes.txt"]


def test_rows_without_a_target_stay_once(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", None)], "name string, label int")
    got = sampling.balance_classes(df, {0: 3, 1: 1}).groupBy("source_name").count().collect()
    assert {r.source_name: r["count"] for r in got} == {"a": 3, "b": 1, "c": 1, "d": 1}
    assert "c" in {r.name for r in sampling.balance_classes(df, {0: 3, 1: 1}).collect()}


def test_copies_of_one_row_cover_many_tasks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1)], "name string, label int")
    copies = sampling.balance_classes(df, {0: 200_000, 1: 1}).withColumn("task", F.spark_partition_id())
    tasks = {r.task: r["count"] for r in copies.groupBy("task").count().collect()}
    assert sum(tasks.values()) == 200_001 and len(tasks) >= 4 and max(tasks.values()) < 100_000
    assert copies.select("name").distinct().count() == 200_001


def test_label_columns_are_demanded(spark):
    with pytest.raises(SchemaError, match="notes"):
        labelling.normalise_labels(spark.createDataFrame([("a", "swan")], "image_name string, animal string"))
    ok = spark.createDataFrame([("a", "swan", "n", 1)], "image_name string, animal string, notes string, extra int")
    assert tuple(labelling.normalise_labels(ok).first()) == ("a", "swan", "n")


def test_schema_check_names_columns(spark):
    with pytest.raises(SchemaError, match="path.*name: bigint"):
        validate(spark.range(1).select(F.col("id").alias("name")), FILES)


def test_managed_table_is_replaced_with_its_schema(spark):
    tables.replace_managed(spark.range(3), "training_rows")
    tables.replace_managed(spark.range(2).select(F.col("id").cast("string").alias("other")), "training_rows")
    assert tables.read_managed(spark, "training_rows").columns == ["other"]
    spark.sql("DROP TABLE training_rows")


def test_partitioned_table_prunes_classes(spark, tmp_path):
    tables.write_table(classes(spark), f"{tmp_path}/gold", partition_by=["label"])
    plan = spark.read.parquet(f"{tmp_path}/gold").where("label = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan


def test_run_log(spark, tmp_path):
    for i in range(7):
        runlog.log_run(spark, f"{tmp_path}", f"e{i % 2}", f"r{i}", datetime(2024, 1, 1 + i), {"reg": "0.1"},
                       {"f1": i / 10}, {"Training-Input": "gold"})
    runs = runlog.read_runs(spark, f"{tmp_path}")
    assert [r.run_id for r in runlog.recent_runs(runs).collect()] == ["r6", "r5", "r4", "r3", "r2"]
    assert {(r.experiment, r.n_runs) for r in runlog.experiments(runs).collect()} == {("e0", 4), ("e1", 3)}
    assert runlog.experiment_runs(runs, "e1").count() == 3
    assert runlog.read_metrics(spark, f"{tmp_path}").where("metric = 'f1'").count() == 7


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"))
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))


def test_cut_lineage_writes_to_the_named_folder(spark):
    cut = cut_lineage(spark.range(10).withColumn("x", F.rand(1)), "test")
    assert shared_dir(spark) in cut.inputFiles()[0]
    assert build_session().conf.get("spark.checkpoint.dir") == shared_dir(spark)
