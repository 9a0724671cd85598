"""Scores, metrics, heads, streams, and the whole way from files to scores."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pictures import arrays, noise, table, write_png
from pyspark.sql import functions as F

from framescore.functions import jsonio
from framescore.functions.probability import argmax, softmax, with_scores
from framescore.operators import evaluate, scoring, tensors
from framescore.plans import dataset, model
from framescore.schema import SCORES, SchemaError, validate
from framescore.sources.images import read_images, valid
from framescore.streaming import score as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_published_example(spark):
    probs = one(spark, softmax(F.lit([-2.17, 3.16])))
    assert probs == pytest.approx([0.0047, 0.9953], abs=2e-4)
    assert sum(probs) == pytest.approx(1)


def test_softmax_of_large_logits(spark):
    assert one(spark, softmax(F.lit([1000.0, 1000.0]))) == [0.5, 0.5]
    assert one(spark, softmax(F.lit([-1000.0, 1000.0]))) == [0.0, 1.0]


def test_argmax_takes_the_first(spark):
    assert one(spark, argmax(F.lit([0.2, 0.4, 0.4]))) == 1


@pytest.mark.parametrize(("reply", "expected"), [
    ('{"label": "swan"}', '{"label": "swan"}'),
    ('  \n{"label": 1}\t', '{"label": 1}'),
    ('ok:\n```json\n{"a":\n 1}\n```\nbye ```json {"b": 2} ```', '{"a":\n 1}'),
    ("```json\nopen", "```json\nopen"),
])
def test_fenced_json(spark, reply, expected):
    assert one(spark, jsonio.fenced_json(F.lit(reply))) == expected


def test_requests(spark):
    import json

    values = F.lit([float(i) for i in range(24)])
    body = json.loads(one(spark, jsonio.instances_request(values, [2, 3, 4])))
    assert np.array_equal(np.array(body["instances"]), np.arange(24.0).reshape(1, 2, 3, 4))
    tensor = json.loads(one(spark, jsonio.tensor_request(values, [2, 3, 4])))["inputs"]["tensor"]
    assert tensor["shape"] == [1, 2, 3, 4] and tensor["values"] == list(range(24))


def test_score_reply(spark):
    bodies = [(1, '{"predictions": [[-2.17, 3.16], [1.0, 2.0]]}'), (2, '{"predictions": []}'), (3, "oops"), (4, None)]
    rows = jsonio.explode_predictions(spark.createDataFrame(bodies, "id int, body string"), F.col("body")).collect()
    got = sorted(((r.id, r.position, r.logits) for r in rows), key=str)
    assert got == [(1, 0, [-2.17, 3.16]), (1, 1, [1.0, 2.0]), (2, None, None), (3, None, None), (4, None, None)]


def test_data_url_has_no_line_breaks(spark):
    import base64

    data = bytes(range(256)) * 3
    url = one(spark, jsonio.data_url(F.lit(data)))
    assert url == "data:image/jpeg;base64," + base64.b64encode(data).decode()


def predictions(spark):
    rows = [(0, 0, 0.9), (0, 0, 0.8), (0, 1, 0.3), (1, 1, 0.1), (1, 0, 0.6), (1, 1, 0.2), (1, 1, 0.05)]
    return spark.createDataFrame(rows, "label int, pred_class int, anomaly_score double")


def test_metrics_by_hand(spark):
    df = predictions(spark)
    f1 = evaluate.f1_scores(df).first()
    assert f1.accuracy == pytest.approx(5 / 7)
    assert f1.f1_normal == pytest.approx(6 / 8) and f1.f1_abnormal == pytest.approx(4 / 6)
    assert {tuple(r) for r in evaluate.confusion_matrix(df).collect()} == {(0, 2, 1), (1, 1, 3)}
    sweep = {r.threshold: r for r in evaluate.threshold_sweep(df, [0.25, 0.5]).collect()}
    assert sweep[0.25].false_positive_rate == pytest.approx(1 / 4) and sweep[0.25].false_negative_rate == 0
    assert sweep[0.5].false_negative_rate == pytest.approx(1 / 3)
    apart = evaluate.score_separation(df).first()
    assert not apart.separated and apart.gap == pytest.approx(-0.3)
    stats = {r.label: r for r in evaluate.score_stats(df).collect()}
    assert stats[0].std_score == pytest.approx(np.std([0.9, 0.8, 0.3]))


def test_metrics_read_rows_once_and_never_cross(spark):
    plan = evaluate.threshold_sweep(predictions(spark), [0.1] * 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Nested" not in plan and "Cartesian" not in plan


def test_tensors(spark):
    a = noise(300, 200)
    df = table(spark, {"a": a, "b": noise(10, 12, 1)})
    rows = {r.name: np.array(r.t) for r in df.select("name", tensors.to_tensor(F.col("image")).alias("t")).collect()}
    assert all(len(t) == 3 * 224 * 224 and -1 <= t.min() and t.max() <= 1 for t in rows.values())
    plain = df.select("name", tensors.to_tensor(F.col("image"), normalise=False).alias("t")).where("name = 'a'").first().t
    assert np.allclose((np.array(plain) - 0.5) / 0.5, rows["a"], atol=1e-6)
    red = np.array(plain).reshape(3, 224, 224)[0]
    assert abs(red.mean() - a[..., 0].mean() / 255) < 0.01


@pytest.mark.parametrize("shape", [(33, 50, 3), (5, 8, 3), (64, 64, 1)])
def test_pooled_features_by_hand(shape):
    a = noise(*shape)
    got = tensors.pooled(a[None], 8)[0].reshape(3, 8, 8)
    h, w = max(shape[0], 8), max(shape[1], 8)
    grey = a[np.arange(h) * 2 * shape[0] // (2 * h)][:, np.arange(w) * 2 * shape[1] // (2 * w)].mean(axis=2) / 255
    if h == shape[0]:
        for i in range(8):
            for j in range(8):
                block = grey[i * h // 8: (i + 1) * h // 8, j * w // 8: (j + 1) * w // 8]
                assert np.allclose(got[:, i, j], [block.mean(), block.min(), block.max()], atol=1e-5)
    assert (got[1] <= got[0] + 1e-6).all() and (got[0] <= got[2] + 1e-6).all()


def make_image_model():
    """A loader defined inside a function, so that it travels to workers by value."""
    def load():
        return lambda x: np.stack([x.mean(axis=(1, 2, 3)), x[:, 0].mean(axis=(1, 2))], axis=1)

    return load


image_model = make_image_model()


def test_image_scores_match_the_tensors(spark):
    df = table(spark, {f"{i}": noise(40 + i % 3, 50, seed=i) for i in range(9)})
    logits = scoring.image_logits(F.col("image"), image_model, 32, batch_size=2)
    scored = scoring.score_table(df, logits, ["name"])
    expected = df.select("name", tensors.to_tensor(F.col("image"), 32).alias("t")).collect()
    got = {r.name: r.logits for r in scored.collect()}
    for r in expected:
        t = np.array(r.t).reshape(1, 3, 32, 32)
        assert np.allclose(got[r.name], image_model()(t)[0], atol=1e-6)


def test_score_signature_is_checked(spark):
    with pytest.raises(SchemaError, match="anomaly_score"):
        validate(spark.range(1), SCORES)


def test_linear_head_is_the_same_in_python_and_in_catalyst(spark):
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=(2, 5)).tolist(), [0.25, -1.0]
    df = spark.createDataFrame([([float(x) for x in v],) for v in rng.normal(size=(20, 5))], "f array<double>")
    from framescore.functions.probability import linear_logits

    a = df.select(linear_logits(F.col("f"), weights, bias).alias("z")).collect()
    b = df.select(scoring.vector_logits(F.col("f"), scoring.linear_predict(weights, bias), 5).alias("z")).collect()
    assert np.allclose([r.z for r in a], [r.z for r in b])


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(1)
    for i in range(1, 10):
        base = np.linspace(60, 120, 72)[None, :, None] + rng.normal(0, 3, (48, 72, 3))
        write_png(root / "images" / f"frame_{i:03d}.jpg", base.clip(0, 255).astype(np.uint8))
        hurt = base.copy()
        hurt[10:40, 20:50] = 255 * (i % 2)
        write_png(root / "noisy" / f"frame_{i:03d}_noisy.jpg", hurt.clip(0, 255).astype(np.uint8))
    (root / "images" / "cut.jpg").write_bytes((root / "images" / "frame_001.jpg").read_bytes()[:50])
    lines = [f'"frame_{i:03d}","swan","ok"' for i in range(1, 10)]
    (root / "labels").mkdir()
    (root / "labels" / "labels.csv").write_text('"image_name","label","notes"\n' + "\n".join(lines) + "\n")
    return root


@pytest.fixture(scope="module")
def gold(spark, photos):
    final = dataset.ingest(spark, f"{photos}/images", f"{photos}/labels", f"{photos}/noisy", f"{photos}/out")
    return dataset.gold(spark, final, f"{photos}/out", targets={1: 60, 0: 120})


def test_ingest(spark, photos, gold):
    final = spark.read.parquet(f"{photos}/out/images_final")
    assert {(r.label, r["count"]) for r in final.groupBy("label").count().collect()} == {("swan", 18), ("noisy", 18)}
    assert [r.name for r in dataset.rejected_files(spark, f"{photos}/out").collect()] == ["cut.jpg"]
    assert {(r.height, r.width) for r in final.select("image.height", "image.width").collect()} == {(256, 256)}
    assert final.where("name like '%flipped.jpg' and label = 'swan' and path <> 'n/a'").count() == 0
    pair = arrays(final.where("name like 'frame_003%' and label = 'swan'"))
    assert (pair["frame_003.jpg"][:, ::-1] == pair["frame_003_flipped.jpg"]).all()


def test_gold(spark, photos, gold):
    abnormal = spark.read.parquet(f"{photos}/out/images_noisy_final")
    assert abnormal.where("name like '%damaged.jpg'").count() == 18
    assert abnormal.where("name like '%\\_tr_.jpg'").count() == 90
    assert {(r.label, r["count"]) for r in gold.groupBy("label").count().collect()} == {(1, 54), (0, 108)}
    assert gold.select("name").distinct().count() == 162
    names = {r.name for r in gold.select("name").collect()}
    assert "frame_001_damaged_tr0.jpg" in names


def test_gold_is_the_same_when_made_again(spark, photos, gold):
    final = spark.read.parquet(f"{photos}/out/images_final").repartition(9)
    again = dataset.gold(spark, final, f"{photos}/again", targets={1: 60, 0: 120})
    digest = lambda df: {(r.name, r.d) for r in df.select("name", F.md5("image.data").alias("d")).collect()}
    assert digest(gold) == digest(again)


def test_train_and_score(spark, photos, gold):
    head, rows = model.train(
        spark, model.training_rows(gold), f"{photos}/runs", "e", "r1", datetime(2024, 1, 1), "gold",
        grid=(0.001, 0.1), iterations=25,
    )
    baseline = evaluate.prior_baseline(rows).first()
    assert head.metrics["f1_macro"] > 0.9 > baseline.f1_macro
    scored = model.score(rows, head, ["name", "label", "split"])
    again = evaluate.f1_scores(scored.where("split = 'eval'")).first()
    assert again.f1_normal == pytest.approx(head.metrics["f1_normal"])
    assert spark.read.parquet(f"{photos}/runs/run_inputs").first().table_name == "gold"


def test_image_stream_equals_batch(spark, photos, tmp_path):
    query = streaming.score_image_stream(
        spark, f"{photos}/images", image_model, f"{tmp_path}/scores", f"{tmp_path}/progress", size=32
    )
    query.awaitTermination()
    batch = scoring.score_table(
        valid(read_images(spark, f"{photos}/images")), scoring.image_logits(F.col("image"), image_model, 32), ["name", "path"]
    )
    rows = spark.read.parquet(f"{tmp_path}/scores").collect()
    assert [(r.name, r.anomaly_score) for r in rows if not r.ok] == [("cut.jpg", None)]
    streamed = {r.name: r.anomaly_score for r in rows if r.ok}
    assert streamed == {r.name: r.anomaly_score for r in batch.collect()} and len(streamed) == 9
    query = streaming.score_image_stream(
        spark, f"{photos}/images", image_model, f"{tmp_path}/scores", f"{tmp_path}/progress", size=32
    )
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scores").count() == 10


def test_streamed_append_adds_each_key_once(spark, tmp_path):
    rows = [("a", "1"), ("a", "0"), ("b", "1")]
    spark.createDataFrame(rows, "name string, path string").write.parquet(f"{tmp_path}/in")
    for checkpoint in ("c1", "c2"):
        stream = streaming.stream_table(spark, f"{tmp_path}/in")
        streaming.append_new_stream(stream, f"{tmp_path}/out", "name", ["path"], f"{tmp_path}/{checkpoint}").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", "0"), ("b", "1")}


def test_scores_of_plain_logits(spark):
    df = spark.createDataFrame([([-2.17, 3.16],)], "logits array<double>")
    row = with_scores(df).first()
    assert row.pred_class == 1 and row.confidence == pytest.approx(0.9952, abs=1e-3)
