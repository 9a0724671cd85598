"""Queries that write to a fresh shared path and read back what they wrote, and their SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescore.functions import names
from framescore.functions.probability import linear_logits, with_scores
from framescore.operators import combine, epochs, head, labelling, pixels, runlog, sampling
from framescore.plans import model
from framescore.plans.oracles import GRID, IMG, LEVELS, ORACLES, SCORED
from framescore.plans.labelling import label_stream
from framescore.plans.queries import HEAD, NO_BIAS, grids, images, odd_length_refused, pictures, query, r6, table
from framescore.schema import IMAGE_METADATA, LABEL_REPLIES
from framescore.session import cut_lineage, new_shared_path, shuffle_tasks
from framescore.sources import images as image_files
from framescore.sources import labels as label_files
from framescore.sources import tables
from framescore.sources.bucketed import read_bucketed, write_bucketed
from framescore.sources.ledger import KeyLedger
from framescore.streaming.append import append_keyed_stream, state_on_disk
from framescore.streaming.report import read_report, report_stream
from framescore.streaming.score import stream_table, write_stream
from framescore.streaming.stride import stride_stream

REG = 0.01


def awkward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose notes hold quotes, commas, line breaks and nothing."""
    event = F.col("event_id").cast("string")
    notes = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('said "'), event, F.lit('", left')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("two\nlines "), event))
        .when(F.col("event_id") % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit("it's, "), event))
    )
    name = F.concat(F.lit("event_"), event)
    return table(spark, sf_dir, "events").select(name.alias("image_name"), F.col("event_type").alias("label"), notes.alias("notes"))


AWKWARD = (
    "SELECT 'event_' || event_id AS image_name, event_type AS label, CASE event_id % 4 "
    "WHEN 0 THEN 'said \"' || event_id || '\", left' WHEN 1 THEN 'two' || chr(10) || 'lines ' || event_id "
    "WHEN 3 THEN 'it''s, ' || event_id END AS notes FROM events"
)


@query
def label_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice, so the first output is replaced; every field quoted."""
    path = new_shared_path(spark, "labels-csv")
    rows = awkward_labels(spark, sf_dir)
    label_files.write_labels_csv(rows.limit(5), path)
    label_files.write_labels_csv(rows, path)
    return label_files.read_labels(spark, path, multi_line=True)


@query
def label_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "labels-json")
    label_files.write_labels_json(awkward_labels(spark, sf_dir), path)
    return label_files.read_labels_json(spark, path)


@query
def table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "overwrite")
    rows = images(spark, sf_dir).select("name", "path")
    tables.write_table(rows.where("name LIKE 'doc_1%'"), path)
    tables.write_table(rows, path)
    return tables.read_table(spark, path)


@query
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends that overlap: no name is there twice."""
    path = new_shared_path(spark, "append")
    rows = images(spark, sf_dir).select("name", "path")
    tables.append_new(spark, rows.where("name LIKE '%.jpg'"), path, "name", ["path"])
    tables.append_new(spark, rows, path, "name", ["path"])
    return tables.read_table(spark, path)


def stored_pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A third of the pictures, the others and some of the first again, and all of them, as stored files with pixels."""
    base = new_shared_path(spark, "pictures")
    rows = pictures(spark, sf_dir)
    for name, part in (("a", "vec_id % 3 = 0"), ("b", "vec_id % 3 <> 0 OR vec_id % 2 = 0"), ("c", "true")):
        tables.write_table(rows.where(part), f"{base}/{name}")
    return tuple(tables.read_table(spark, f"{base}/{name}") for name in "abc")


@query
def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping appends of pictures by a key ledger, with how many rows each one added."""
    store = KeyLedger(spark, new_shared_path(spark, "ledger"), "name")
    added = [store.append(part, ["vec_id"], f"batch-{i}") for i, part in enumerate(stored_pictures(spark, sf_dir))]
    rows = store.read().select("name", "label", F.length("image.data").alias("n_bytes"))
    return rows.withColumns({f"added_{i}": F.lit(n).cast("bigint") for i, n in enumerate(added)})


@query
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream of several micro-batches, with keys that the ledger knew before; run twice from one checkpoint."""
    first, second, every = stored_pictures(spark, sf_dir)
    base = new_shared_path(spark, "stream-append")
    store = KeyLedger(spark, f"{base}/store", "name")
    store.append(first, ["vec_id"])
    tables.write_table(second.unionByName(every), f"{base}/in")
    for _ in range(2):
        append_keyed_stream(spark, f"{base}/in", store, f"{base}/progress", files_per_batch=8).awaitTermination()
    return store.read().select("name", "label", F.length("image.data").alias("n_bytes"))


@query
def label_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images written in buckets by stem, joined with their labels bucket by bucket."""
    path = new_shared_path(spark, "bucketed")
    listed, named = _listing(spark, sf_dir)
    write_bucketed(listed.withColumn("stem", names.stem(F.col("name"))), path, "stem", 16)
    return combine.join_labels(read_bucketed(spark, path), named).select("name", "label")


@query
def stream_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every n-th event of each user by a stream that gets them in pieces of equal size, in order of time."""
    base = new_shared_path(spark, "stride")
    frames = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    frames.repartitionByRange(5, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(f"{base}/all")
    # One file a micro-batch, the earliest first: files are taken in the order of their times of writing.
    for i in range(5):
        whole = spark.read.parquet(f"{base}/all").withColumn("_part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
        whole.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{base}/in")
    step = 10
    stream = stream_table(spark, f"{base}/in", files_per_batch=1)
    with state_on_disk(spark):
        write_stream(stride_stream(stream, "user_id", ["ts", "event_id"], step), f"{base}/out", f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_id", "frame_no", "frame_name")


@query
def label_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file contents, labelled slice by slice from a stream; a second run finds nothing to do."""
    base = new_shared_path(spark, "queue")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    files = table(spark, sf_dir, "documents").select(name.alias("name"), F.col("text").cast("binary").alias("content"))
    # As many files as the session's shuffles have tasks, so that none holds much of the table, in four slices.
    n = max(4, shuffle_tasks(spark))
    files.repartition(n, "name").write.parquet(f"{base}/in")
    for _ in range(2):
        stream = stream_table(spark, f"{base}/in", files_per_batch=-(-n // 4))
        label_stream(stream, odd_length_refused, f"{base}/replies", f"{base}/progress").awaitTermination()
    return labelling.parse_replies(spark.read.schema(LABEL_REPLIES).parquet(f"{base}/replies"))


def exported(spark: SparkSession, sf_dir: str) -> str:
    """A folder with all pictures as PNG files, and for every tenth one a note and a file that is cut short."""
    folder = new_shared_path(spark, "files")
    rows = pictures(spark, sf_dir).select("vec_id", "name", pixels.encode_png(F.col("image")).alias("content"))
    tenth = rows.where("vec_id % 10 = 0")
    note = tenth.select(F.concat("name", F.lit(".txt")).alias("name"), F.lit("a note").cast("binary").alias("content"))
    cut = tenth.select(F.concat(F.lit("cut_"), "name").alias("name"), F.substring("content", 1, 20).alias("content"))
    image_files.write_files(rows.select("name", "content").unionByName(note).unionByName(cut), folder)
    return folder


@query
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of a folder in order of their names, and the files that are no images."""
    folder = exported(spark, sf_dir)
    images_of = image_files.require_images(image_files.list_images(spark, folder), folder)
    kinds = [(images_of, "image"), (image_files.other_files(spark, folder), "other")]
    return combine.union_all([rows.select("name", names.basename(F.col("path")).alias("base"), F.lit(kind).alias("kind")) for rows, kind in kinds])


@query
def image_files_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures encoded as PNG files and decoded again, pixel by pixel."""
    found = image_files.valid(image_files.read_images(spark, exported(spark, sf_dir)))
    levels = F.posexplode(pixels.levels_of(F.col("image"))).alias("k", "value")
    return found.select("name", F.col("image.height").alias("height"), F.col("image.width").alias("width"), levels)


@query
def image_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that cannot be decoded."""
    return image_files.rejects(image_files.read_images(spark, exported(spark, sf_dir))).select("name")


@query
def label_file_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label file among the files of a folder, whatever its case, and its labels."""
    folder = new_shared_path(spark, "label-file")
    counts = table(spark, sf_dir, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    # One line per type of event.
    lines = counts.agg(F.array_join(F.array_sort(F.collect_list(F.format_string('"%s","%d",""', "event_type", "n"))), "\n").alias("lines"))
    content = F.concat(F.lit("image_name,label,notes\n"), "lines").cast("binary").alias("content")
    names_of = F.explode(F.array(*[F.lit(n) for n in ("b_Labels.CSV", "a_labels.csv.bak", "c_labels.csv")])).alias("name")
    image_files.write_files(lines.select(names_of, content), folder)
    path = label_files.find_label_file(spark, folder)
    return label_files.read_labels(spark, path).select("image_name", "label", F.lit(path.rpartition("/")[2]).alias("file"))


@query
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events by windows of six hours, from a stream that gets them in no order of time."""
    base = new_shared_path(spark, "report")
    score = F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000
    rows = table(spark, sf_dir, "events").select(
        "ts", F.pmod("event_id", F.lit(2)).cast("int").alias("label"), score.alias("anomaly_score"), (score < 0.5).cast("int").alias("pred_class")
    )
    rows.repartition(4).write.parquet(f"{base}/in")
    stream = stream_table(spark, f"{base}/in", files_per_batch=1)
    report_stream(stream, "ts", "6 hours", "100000 days", f"{base}/out", f"{base}/progress").awaitTermination()
    found = read_report(spark, f"{base}/out").withColumns({c: r6(c) for c in ("mean_score", "std_score")})
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")).drop("end")


@query
def managed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed table replaced by one of another schema; its name is new, so that sessions on one warehouse do not meet."""
    name = f"framescore_replaced_{uuid.uuid4().hex}"
    tables.replace_managed(images(spark, sf_dir).select("name", "path"), name)
    tables.replace_managed(grids(spark, sf_dir).select("vec_id", "label"), name)
    return tables.read_managed(spark, name)


@query
def variants_one_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of all rows in one write, by class folders."""
    path = new_shared_path(spark, "variants")
    tables.write_table(sampling.fan_out(grids(spark, sf_dir).select("name", "label"), 3), path, partition_by=["label"])
    return spark.read.parquet(path).select("name", F.col("label").cast("int"), "variant")


@query
def run_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each class logged as a run's metrics, and read back."""
    folder = new_shared_path(spark, "runs")
    counts = {f"label_{r['label']}": float(r["n"]) for r in combine.label_counts(*_listing(spark, sf_dir)).collect()}
    runlog.log_run(spark, folder, "counts", "r1", datetime(2024, 1, 1), {"by": "label"}, counts, {"Input": "documents"})
    done = runlog.read_runs(spark, folder)
    return runlog.read_metrics(spark, folder).join(done.select("run_id", "experiment", "status"), "run_id")


def _listing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from framescore.plans.queries import labels

    return images(spark, sf_dir), labels(spark, sf_dir)


@query
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation that marks an image column, after a write, with the rows it holds."""
    path = new_shared_path(spark, "marked")
    tables.write_table(pictures(spark, sf_dir).select("vec_id", pixels.as_image_column(F.col("image"))), path)
    back = tables.read_table(spark, path)
    kept = back.schema["image"].metadata == IMAGE_METADATA
    return back.select("vec_id", F.lit(kept).alias("marked"))


@query
def rgba_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels to three: the alpha channel goes."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i * 7 + F.col("vec_id").cast("int")) % 256)
    base = pixels.image_from_levels(levels, 2, 2)
    image = F.struct(
        base["origin"].alias("origin"), base["height"].alias("height"), base["width"].alias("width"), F.lit(4).alias("nChannels"),
        F.lit(pixels.MODES[4]).alias("mode"), base["data"].alias("data"),
    )
    done = table(spark, sf_dir, "embeddings").select("vec_id", pixels.to_rgb_channels(image).alias("image"))
    return done.select("vec_id", F.col("image.nChannels").alias("channels"), F.posexplode(pixels.levels_of(F.col("image"))).alias("k", "value"))


@query
def score_from_stored_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head is stored by one job and read by another."""
    folder = new_shared_path(spark, "heads")
    runlog.save_head(spark, folder, "other", [[0.0] * len(HEAD[0])] * 2, [1.0, 0.0], REG)
    runlog.save_head(spark, folder, "mine", HEAD, NO_BIAS, REG)
    scores = model.score_stored(spark, grids(spark, sf_dir), folder, "mine", ["vec_id"], "grid")
    return scores.select("vec_id", r6("anomaly_score").alias("anomaly_score"), "pred_class")


@query
def head_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of the penalised loss at the fitted weights: 0 for every class and feature."""
    rows = sampling.hash_split(grids(spark, sf_dir).withColumnRenamed("grid", "features")).where("split = 'train'")
    fitted = head.fit_head(rows, reg=REG, iterations=500, tol=1e-12)
    slopes = head.gradient(rows, fitted, REG)
    return slopes.select("class", "feature", (F.round("slope", 4) + 0.0).alias("slope"))


@query
def head_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head fitted in epochs and run on to the end: the slopes at its weights are 0, as at those of ``head_optimality``."""
    rows = sampling.hash_split(grids(spark, sf_dir).withColumnRenamed("grid", "features")).select("features", "label", "split")
    rows = cut_lineage(rows, "epochs")
    fitted = epochs.fit_epochs(rows, reg=REG, epochs=200, patience=None, tol=1e-5)
    logits = linear_logits(F.col("features"), fitted.weights, fitted.bias)
    there = with_scores(rows.where("split = 'train'").withColumn("logits", logits))
    return head.slopes(there, fitted.weights, REG).select("class", "feature", (F.round("slope", 4) + 0.0).alias("slope"))


@query
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of each frame on either side of the split: none has both."""
    varied = sampling.fan_out(grids(spark, sf_dir).select("name", "label"), 4)
    named = varied.withColumn("source_name", F.col("name")).withColumn("name", names.with_variant(F.col("name"), F.col("variant")))
    sides = sampling.hash_split(named.withColumn("root", names.root(F.col("name"))), "root")
    return (
        sides.groupBy("source_name", "root").agg(F.count_distinct("split").alias("sides"), F.count(F.lit(1)).alias("variants"))
    )


ORACLES |= {
    "label_csv_roundtrip": AWKWARD,
    "label_json_roundtrip": AWKWARD,
    "table_overwrite": f"WITH {IMG} SELECT name, path FROM img",
    "table_append": f"WITH {IMG} SELECT name, path FROM img",
    "label_file_found": (
        "SELECT event_type AS image_name, count(*)::VARCHAR AS label, 'b_Labels.CSV' AS file FROM events WHERE event_type IS NOT NULL GROUP BY event_type"
    ),
    "image_listing": (
        f"WITH {GRID}, files AS (SELECT name, 'image' AS kind FROM grid UNION ALL SELECT 'cut_' || name, 'image' FROM grid WHERE vec_id % 10 = 0 "
        "UNION ALL SELECT name || '.txt', 'other' FROM grid WHERE vec_id % 10 = 0) SELECT name, name AS base, kind FROM files"
    ),
    "image_files_decoded": f"WITH {LEVELS} SELECT name, 8 AS height, 8 AS width, k::INTEGER AS k, px[k + 1] AS value FROM levels, unnest(range(64)) t(k)",
    "image_rejects": f"WITH {GRID} SELECT 'cut_' || name AS name FROM grid WHERE vec_id % 10 = 0",
    "stream_report": (
        "WITH rows AS (SELECT ts, (event_id % 2)::INTEGER AS label, event_id * 7919 % 1000 / 1000e0 AS s FROM events) "
        "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, label, count(*) AS n, round(avg(s), 6) AS mean_score, "
        "round(sqrt(greatest(avg(s * s) - avg(s) * avg(s), 0)), 6) AS std_score, min(s) AS min_score, max(s) AS max_score, "
        "count(*) FILTER (s >= 0.5) AS pred_abnormal, count(*) FILTER (s < 0.5) AS pred_normal FROM rows GROUP BY ALL"
    ),
    "label_queue": ORACLES["bulk_labelling"],
    "threshold_at_rate": (
        f"WITH {SCORED}, rows AS (SELECT label, round(p0, 6) AS s FROM scored), "
        "counts AS (SELECT s, count(*) FILTER (label = 1) AS normal, count(*) FILTER (label = 0) AS abnormal FROM rows GROUP BY s), "
        "cum AS (SELECT s, sum(normal) OVER (ORDER BY s DESC) AS un, sum(abnormal) OVER (ORDER BY s DESC) AS ua, "
        "sum(normal) OVER () AS tn, sum(abnormal) OVER () AS ta FROM counts), "
        "rates AS (SELECT unnest([0e0, 0.01e0, 0.05e0, 0.25e0, 1e0]) AS rate), "
        "totals AS (SELECT any_value(tn) AS tn, any_value(ta) AS ta FROM cum), "
        "found AS (SELECT rate, min(s) AS t, max(un) AS un, max(ua) AS ua FROM rates JOIN cum ON un <= rate * cum.tn GROUP BY rate) "
        "SELECT rate, coalesce(t, 'infinity'::DOUBLE) AS threshold, coalesce(un, 0)::BIGINT AS false_alarms, "
        "round(coalesce(un, 0) / tn, 6) AS false_alarm_rate, (ta - coalesce(ua, 0))::BIGINT AS missed, "
        "round((ta - coalesce(ua, 0)) / ta, 6) AS miss_rate FROM rates LEFT JOIN found USING (rate), totals"
    ),
    "append_ledger": (
        f"WITH {GRID}, added AS (SELECT count(*) FILTER (vec_id % 3 = 0) AS added_0, count(*) FILTER (vec_id % 3 <> 0) AS added_1, "
        "0::BIGINT AS added_2 FROM embeddings) SELECT name, label, 64 AS n_bytes, added_0, added_1, added_2 FROM grid, added"
    ),
    "stream_append": f"WITH {GRID} SELECT name, label, 64 AS n_bytes FROM grid",
    "label_join_bucketed": ORACLES["label_left_join"],
    "stream_stride": ORACLES["stride_sample"],
    "managed_replace": f"WITH {GRID} SELECT vec_id, label FROM grid",
    "variants_one_write": f"WITH {GRID} SELECT name, label, v::INTEGER AS variant FROM grid, unnest(range(3)) t(v)",
    "run_log_roundtrip": (
        "SELECT 'r1' AS run_id, 'label_' || coalesce(quality::VARCHAR, 'None') AS metric, count(*)::DOUBLE AS value, "
        "'counts' AS experiment, 'FINISHED' AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality"
    ),
    "image_metadata": "SELECT vec_id, true AS marked FROM embeddings",
    "rgba_to_rgb": (
        "SELECT vec_id, 3 AS channels, k::INTEGER AS k, (((k // 3 * 4 + k % 3) * 7 + vec_id) % 256)::INTEGER AS value "
        "FROM embeddings, unnest(range(12)) t(k)"
    ),
    "score_from_stored_head": f"WITH {SCORED} SELECT vec_id, round(p0, 6) AS anomaly_score, pred_class FROM scored",
    "head_optimality": (
        "SELECT c::INTEGER AS class, j::INTEGER AS feature, 0e0 AS slope FROM unnest(range(2)) a(c), unnest(range(64)) b(j)"
    ),
    "head_early_stop": (
        "SELECT c::INTEGER AS class, j::INTEGER AS feature, 0e0 AS slope FROM unnest(range(2)) a(c), unnest(range(64)) b(j)"
    ),
    "split_by_source": f"WITH {GRID} SELECT name AS source_name, name AS root, 1::BIGINT AS sides, 4::BIGINT AS variants FROM grid",
}
