"""Rules, mixing, sharding, pages and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import odd_docs, odd_rows, prose

import corpus_pipeline
from framescore.llm import hostrules, htmltext, mixing, sharding
from framescore.llm.scratch import Scratch
from framescore.llm.words import WORD

SF = "/root/testdata/sf0.001"


def _documents(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r for r in rows])
    return con


def test_rules_equal_sql_on_odd_rows(spark):
    rows = {r[0]: (r[0], r[1], r[3]) for r in odd_rows() if r[0] is not None and "\x00" not in (r[1] or "")}
    want = {r[0]: r for r in _documents(rows.values()).sql(hostrules.ORACLE).fetchall()}
    df = spark.createDataFrame(list(rows.values()), "doc_id bigint, text string, source string")
    got = {r.doc_id: tuple(r) for r in hostrules.judge(df, Scratch(spark, "t")).collect()}
    assert got == want


def test_host_verdicts_reject_only_failing_documents_of_failing_hosts(spark):
    clean = [prose(80, i) for i in range(300)]
    junk = [t.replace(" ", " ### ") for t in clean]
    rows = [(i, t, "good") for i, t in enumerate(clean[:200])] + [(1000 + i, t, "bad") for i, t in enumerate(clean[200:250])]
    rows += [(2000 + i, t, "bad") for i, t in enumerate(junk[:50])] + [(3000, junk[60], "good")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in hostrules.judge(df, Scratch(spark, "t")).where("kept").collect()}
    assert {i for i, *_ in rows if i < 2000} <= kept and not any(2000 <= i < 3000 for i in kept)
    s = Scratch(spark, "t")
    assert {r.doc_id for r in hostrules.keep(df, s).collect()} == kept
    rates = {r.source: r for r in hostrules.host_rates(s.write(hostrules.measure(df), "m")).collect()}
    assert 1 / 201 < rates["good"].rate_symbols < rates["bad"].rate_symbols < 50 / 100


def _fill(sizes, weights, budget, cap):
    target, free = {}, set(sizes)
    while free:
        rest, w = budget - sum(target.values()), sum(weights[s] for s in free)
        over = {s for s in free if w and rest * weights[s] / w > cap * sizes[s]}
        if not over:
            target |= {s: rest * weights[s] / w if w else 0.0 for s in free}
            break
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_water_filling(spark):
    r = random.Random(2)
    for _ in range(6):
        sizes = {f"s{i}": r.choice([0, 1, 5, 100, 3000]) for i in range(r.randint(1, 9))}
        weights = {s: r.choice([1, 2, 5]) for s in sizes}
        budget = r.choice([0.5, 1.5, 1.9]) * sum(sizes.values())
        df = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size bigint, weight int")
        from pyspark.sql import functions as F

        got = {x.source: x.target for x in mixing.water_fill(df, F.lit(float(budget))).collect()}
        want = _fill(sizes, weights, budget, 2)
        assert got == pytest.approx(want)


def test_mix_takes_what_it_says(spark):
    rows = [(i, prose(1 + i % 50, i), f"s{min(3, i // 40)}") for i in range(300)] + [(900, None, None), (901, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    s = Scratch(spark, "t")
    sized = s.write(mixing.sized(df), "sizes")
    taken = mixing.take(sized, s.write(mixing.source_targets(sized), "targets")).collect()
    per_source, source = Counter(), {i: x for i, _, x in rows}
    for r in taken:
        assert r.taken <= 2 * r.size and r.size == len(re.findall(WORD, dict((i, t) for i, t, _ in rows)[r.doc_id] or ""))
        per_source[source[r.doc_id]] += r.taken
    for r in taken:
        assert abs(per_source[source[r.doc_id]] - r.target) <= 0.5 + 1e-6
    got = Counter()
    for r in mixing.materialise(df, spark.createDataFrame(taken)).collect():
        got[r.doc_id] += len(re.findall(WORD, r.text))
    assert got == Counter({r.doc_id: r.taken for r in taken if r.taken})


def test_shards_are_near_equal(spark):
    rows = [(i, "same text " * 30 if i % 3 == 0 else prose(20 + i % 60, i), "en", "hot" if i % 2 else f"s{i % 7}", i % 500) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    s = Scratch(spark, "t")
    shards = s.write(sharding.kd_shards(df, s, n_shards=13), "shards")
    placed = sharding.with_slots(shards, "shard", ["doc_id"], "slot", chunks=7).collect()
    total, slots = Counter(), defaultdict(list)
    for r in placed:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(placed) == 6000 and set(total) == set(range(13)) and max(total.values()) < 1.03 * min(total.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.kd_shards(df.repartition(3), s, n_shards=13).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.shard) for r in placed}
    by_bytes = sharding.kd_shards(df, s, target_bytes=100_000).groupBy("shard").sum("size").collect()
    assert len(by_bytes) == -(-sum(total.values()) // 100_000)


def test_pages_held_out():
    r = random.Random(5)
    texts = [[prose(r.randint(3, 60), 10 * i + j) for j in range(12)] for i in range(160)]
    other = [prose(r.randint(3, 30), 9000 + i) for i in range(60)]
    layouts = [htmltext._layout(r, t[: r.randint(2, 12)], other) for t in texts for _ in range(4)]
    model = htmltext.fit(layouts[:480])
    good = 0
    for html, content in layouts[480:]:
        page = htmltext.Page(html)
        good += model.texts([page])[0].split("\n") == [t for _, t in page.blocks if t in content]
    assert good >= 0.95 * len(layouts[480:])


def test_marginals_are_exact():
    page = htmltext.Page("<body><div class=nav><p>a</p></div><article><p>b<ul><li>c</ul></article></body>")
    forest = htmltext.Forest([page])
    import numpy as np

    rng = np.random.default_rng(1)
    model = htmltext.Model(rng.normal(size=htmltext.N_FEATURES), rng.normal(size=(len(htmltext.TAGS) + 1, 2, 2)))
    n, u = len(forest.parent), forest.x @ model.weights
    total, per = 0.0, np.zeros(n)
    for mask in range(1 << n):
        y = [mask >> i & 1 for i in range(n)]
        p = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(model.edge[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, n)))
        total, per = total + p, per + p * np.array(y)
    assert np.allclose(model.solve(forest)[0], per / total)


def test_markup_as_browsers_read_it():
    html = "<p>one <b>two<br>three &amp; &eacute;\n\n four<p>five<script>var t='</p>'</script><!-- no --><ul><li>six<li>seven</ul>a<div title='a>b'>eight</div>nine<textarea>no</textarea"
    assert [t for _, t in htmltext.Page(html).blocks] == ["one two three & é four", "five", "six", "seven", "a", "eight", "nine"]
    assert htmltext.Page("").blocks == [] and htmltext.Page("<").blocks == [(0, "<")]


def test_extract_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>The town was glad of it. It grew, year by year, and more came.</p></article>"), (3, "v", "<div>" * 3000 + "deep"), (3, "v", "<p")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = htmltext.extract(df).collect()
    assert len(out) == 5 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert htmltext.extract(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, kept = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        kept[name], docs = docs, spark.read.parquet(str(tmp_path / name))
    quality, near, cut, mixed, packed = (spark.read.parquet(str(tmp_path / n)) for n, _ in corpus_pipeline.STAGES)
    assert 0 < near.count() <= quality.count() < before
    assert quality.columns == near.columns == cut.columns == mixed.columns
    words = lambda d: sum(len(re.findall(WORD, r.text)) for r in d.collect())
    assert words(cut) <= words(near) and abs(words(mixed) - 1.5 * words(cut)) < 20 * 1
    assert near.select("doc_id").distinct().count() == near.count()
    whole = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in whole) <= 2048
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_odd_docs_have_the_clashing_names(spark):
    assert {"key", "size", "shard", "target"} <= set(odd_docs(spark).columns)


@pytest.mark.parametrize("odd", [
    '<svg class="x" viewBox="0 0 1 1"/>', "<svg-icon name=a></svg-icon>", "<button-group></button-group>", "<select-box></select-box>", "<svg><path d='M0'/>",
    "<svg><title/><path/></svg>", "<button>Open", "<select><option>one<option>two", "<div><button>Open</div>", "<template>Open", "<script x='>no</script>", "<button>a<button>b</button>", "<svg><g><svg/></g></svg>",
    "<style-guide></style-guide>", '<script data-x="a>b">var a = "<p>no</p>"</script>', "<button>Open <div>more</div></button>", "<svg><title>Icon</title></svg>",
])
def test_text_behind_a_control_or_image_is_read(odd):
    page = htmltext.Page(f"<body><div>{odd}<p>First text.</p><p>Last <b>text</b>.</p></div><footer>End</footer></body>")
    assert [t for _, t in page.blocks] == ["First text.", "Last text.", "End"]


def test_controls_do_not_cut_a_paragraph():
    html = "<p>One <button>no<i>no</i><div>no</div></button> two <svg><path/><text>no</text></svg>three <select><option>no</option></select>four</p><p>five</p>"
    assert [t for _, t in htmltext.Page(html).blocks] == ["One two three four", "five"]


def test_the_packed_sequences_can_be_rebuilt(spark):
    rows = corpus_pipeline.pack(spark, odd_docs(spark), "").collect()
    assert rows and all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
