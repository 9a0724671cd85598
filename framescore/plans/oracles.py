"""The same queries in SQL for another engine, written from the definitions."""

from __future__ import annotations

from framescore.functions.indexmaps import SOURCE_OF, TRANSFORMS
from framescore.plans.queries import BIG, CELLS, FPS, SIDE, TARGETS, THRESHOLDS

IMG = (
    "img AS (SELECT doc_id, 'doc_' || doc_id || ['.jpg', '.JPG', '.png', '.jpeg'][doc_id % 4 + 1] AS name, "
    "'lake:/images/' || name AS path FROM documents)"
)
LAB = "lab AS (SELECT 'doc_' || doc_id AS stem, quality AS label FROM labels)"
JOINED = (
    f"{IMG}, {LAB}, joined AS (SELECT i.*, l.label FROM img i LEFT JOIN lab l ON regexp_replace(i.name, '\\.[^.]*$', '') = l.stem)"
)
GRID = (
    "grid AS (SELECT vec_id, 'vec_' || vec_id || ['.jpg', '.JPG', '.png', '.jpeg'][vec_id % 4 + 1] AS name, "
    "CASE WHEN label < 2 THEN 0 ELSE 1 END AS label, embedding::DOUBLE[] AS g FROM embeddings)"
)
LEVELS = (
    f"{GRID}, levels AS (SELECT vec_id, name, label, list_transform(g, lambda v: "
    "least(255, greatest(0, floor((v + 1e0) / 2e0 * 255e0)::INTEGER))) AS px FROM grid)"
)
EVENTS = (
    "replies AS (SELECT 'event_' || event_id || '.jpg' AS name, 'event_' || event_id AS image_name, event_type, "
    "'{\"' || CASE WHEN event_type = 'click' THEN 'animal' ELSE 'label' END || '\": \"' || event_type || "
    "'\", \"notes\": \"' || json_extract_string(props, '$.k') || '\"}' AS doc, "
    "'no label: ' || props AS broken, json_extract_string(props, '$.k') AS notes FROM events)"
)


def h(text: str) -> str:
    """A whole number in [0, 2^32) from the md5 of a text."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def u(text: str) -> str:
    return f"({h(text)}::DOUBLE / 4294967296e0)"


def _unit(v: str) -> str:
    """A grey level as a model input in [-1, 1], in single precision as models take it."""
    return f"((({v}::FLOAT / 255::FLOAT) - 0.5::FLOAT) / 0.5::FLOAT)::DOUBLE"


def _dot(cls: int) -> str:
    return (
        f"list_reduce(list_transform(g, lambda v, i: v * (((7 * (i - 1) + 13 * {cls}) % 11 - 5) / 2e0)), "
        "lambda a, b: a + b, 0e0)"
    )


SCORED = (
    f"{GRID}, heads AS (SELECT vec_id, label, {_dot(0)} AS z0, {_dot(1)} AS z1 FROM grid), "
    "exps AS (SELECT *, exp(z0 - greatest(z0, z1)) AS e0, exp(z1 - greatest(z0, z1)) AS e1 FROM heads), "
    "scored AS (SELECT vec_id, label, z0, z1, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1, "
    "CASE WHEN e0 >= e1 THEN 0 ELSE 1 END AS pred_class FROM exps)"
)
SPLIT = (
    f"{GRID}, split AS (SELECT name, label, "
    f"CASE WHEN {h('name')} % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM grid)"
)
OPS = f"ops AS (SELECT unnest({TRANSFORMS!r}) AS op)"


def _counts_values() -> str:
    return ", ".join(f"({label}, {n})" for label, n in TARGETS.items())


REPS = (
    f"{GRID}, want(label, target) AS (VALUES {_counts_values()}), "
    "counts AS (SELECT label, count(*) AS n_source FROM grid GROUP BY label), "
    "reps AS (SELECT label, n_source, target::BIGINT AS target, "
    "greatest(1, target // n_source)::INTEGER AS reps FROM want JOIN counts USING (label))"
)


def _cells(source: str, n: int, value: str, keep: str = "vec_id", table: str = "grid") -> str:
    return (
        f"WITH {source} SELECT {keep}, k::INTEGER AS k, round(({value})::DOUBLE, 6) AS value "
        f"FROM {table}, unnest(range({n})) t(k)"
    )


def _crop(box: str) -> str:
    return (
        f"WITH {GRID}, views(height, width) AS (VALUES (4, 16), (16, 4)), "
        f"boxes AS (SELECT *, least(height, width) AS side, {box} FROM views) "
        "SELECT vec_id, height, width, k::INTEGER AS k, "
        'round(g[("top" + k // side) * width + "left" + k % side + 1], 6) AS value '
        "FROM grid, boxes, unnest(range(16)) t(k)"
    )


TRIANGLE = "greatest(0e0, 1e0 - abs({t}))"
CUBIC = (
    "(CASE WHEN abs({t}) < 1 THEN 1.5e0 * abs({t}) ** 3 - 2.5e0 * abs({t}) ** 2 + 1 "
    "WHEN abs({t}) < 2 THEN -0.5e0 * abs({t}) ** 3 + 2.5e0 * abs({t}) ** 2 - 4e0 * abs({t}) + 2 ELSE 0e0 END)"
)


def _weights(name: str, n_in: int, n_out: int, kernel: str) -> str:
    step = f"({n_in}e0 / {n_out}e0)"
    raw = kernel.format(t=f"((j + 5e-1 - (i + 5e-1) * {step}) / greatest(1e0, {step}))")
    return (
        f"raw_{name} AS (SELECT i, j, {raw} AS w FROM unnest(range({n_out})) a(i), unnest(range({n_in})) b(j)), "
        f"{name} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w, "
        f"floor(w / sum(w) OVER (PARTITION BY i) * 4194304e0 + 5e-1) AS q FROM raw_{name})"
    )


def _grid_resize(kernel: str) -> str:
    return (
        f"WITH {GRID}, {_weights('wx', 8, 11, kernel)}, {_weights('wy', 8, 5, kernel)}, "
        "across AS (SELECT vec_id, y, wx.i AS x, sum(g[y * 8 + wx.j + 1] * wx.w) AS v "
        "FROM grid, unnest(range(8)) t(y), wx GROUP BY ALL) "
        "SELECT vec_id, (wy.i * 11 + x)::INTEGER AS k, round(sum(v * wy.w), 6) AS value "
        "FROM across JOIN wy ON wy.j = y GROUP BY vec_id, wy.i, x"
    )


def _byte(total: str) -> str:
    return f"least(255, greatest(0, floor(({total} + 2097152e0) / 4194304e0)))::INTEGER"


def _pixel_resize(kernel: str) -> str:
    return (
        f"WITH {LEVELS}, {_weights('wx', 8, 11, kernel)}, {_weights('wy', 8, 5, kernel)}, "
        f"across AS (SELECT vec_id, y, wx.i AS x, {_byte('sum(px[y * 8 + wx.j + 1] * wx.q)')} AS v "
        "FROM levels, unnest(range(8)) t(y), wx GROUP BY vec_id, y, wx.i) "
        f"SELECT vec_id, 5 AS height, 11 AS width, (wy.i * 11 + x)::INTEGER AS k, {_byte('sum(v * wy.q)')} AS value "
        "FROM across JOIN wy ON wy.j = y GROUP BY vec_id, wy.i, x"
    )


# The affine map of an 8x8 image: four source cells and two blend shares per cell.
AFFINE = (
    "pts AS (SELECT k, (x * 1e0 + y * 3e-1) + 8 * (-1.5e-1) AS sx, (x * 3e-1 + y * 1e0) + 8 * (-1.5e-1) AS sy "
    "FROM (SELECT k, k % 8 + 5e-1 AS x, k // 8 + 5e-1 AS y FROM unnest(range(64)) t(k))), "
    "floors AS (SELECT *, floor(sx - 5e-1)::INTEGER AS fx, floor(sy - 5e-1)::INTEGER AS fy FROM pts), "
    "taps AS (SELECT k, sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 AS seen, "
    "sx - 5e-1 - fx AS dx, sy - 5e-1 - fy AS dy, "
    "least(greatest(fy, 0), 7) * 8 + least(greatest(fx, 0), 7) + 1 AS a, "
    "least(greatest(fy, 0), 7) * 8 + least(greatest(fx + 1, 0), 7) + 1 AS b, "
    "CASE WHEN fy + 1 >= 0 AND fy + 1 < 8 THEN fy + 1 ELSE least(greatest(fy, 0), 7) END * 8 "
    "+ least(greatest(fx, 0), 7) + 1 AS c, "
    "CASE WHEN fy + 1 >= 0 AND fy + 1 < 8 THEN fy + 1 ELSE least(greatest(fy, 0), 7) END * 8 "
    "+ least(greatest(fx + 1, 0), 7) + 1 AS d FROM floors)"
)


def _blend(v: str, t: str) -> str:
    up = f"({v}[{t}.a] + ({v}[{t}.b] - {v}[{t}.a]) * {t}.dx)"
    low = f"({v}[{t}.c] + ({v}[{t}.d] - {v}[{t}.c]) * {t}.dx)"
    return f"({up} + ({low} - {up}) * {t}.dy)"


def _turn(op: str, k: str = "k") -> str:
    """The 1-based source cell of cell ``k`` in an 8x8 image."""
    y, x = f"({k} // 8)", f"({k} % 8)"
    return {
        "horizontal": f"{y} * 8 + (7 - {x}) + 1",
        "vertical": f"(7 - {y}) * 8 + {x} + 1",
        "rotate_90": f"{x} * 8 + (7 - {y}) + 1",
        "rotate_180": f"(7 - {y}) * 8 + (7 - {x}) + 1",
        "rotate_270": f"(7 - {x}) * 8 + {y} + 1",
    }[op]


TURNS = list(SOURCE_OF)


def _plan(variants: int) -> str:
    key = "name || '|' || variant || '|'"
    return (
        f"{OPS}, copies AS (SELECT vec_id, name, v::INTEGER AS variant FROM grid, unnest(range({variants})) t(v)), "
        f"plans AS (SELECT vec_id, name, variant, "
        f"list_slice(list(op ORDER BY md5({key} || op)), 1, 1 + {h(key + chr(32) + '|| ' + repr('n'))} % 6) AS ops "
        "FROM copies, ops GROUP BY vec_id, name, variant)"
    )


def _augment() -> str:
    steps = ["s0 AS (SELECT p.vec_id, variant, ops, px FROM plans p JOIN levels USING (vec_id))"]
    for i in range(1, 7):
        turns = " ".join(
            f"WHEN '{op}' THEN list_transform(range(64), lambda k: px[{_turn(op)}])" for op in TURNS
        )
        skewed = (
            "list_transform(m, lambda t: CASE WHEN t.seen THEN "
            f"floor({_blend('px', 't')})::INTEGER ELSE 0 END)"
        )
        steps.append(
            f"s{i} AS (SELECT vec_id, variant, ops, CASE ops[{i}] {turns} "
            f"WHEN 'squash&skew' THEN {skewed} ELSE px END AS px FROM s{i - 1}, map)"
        )
    return (
        f"WITH {LEVELS}, {AFFINE}, map AS (SELECT list(taps ORDER BY k) AS m FROM taps), {_plan(2)}, "
        + ", ".join(steps)
        + " SELECT vec_id, variant, 8 AS height, 8 AS width, k::INTEGER AS k, px[k + 1]::INTEGER AS value "
        "FROM s6, unnest(range(64)) t(k)"
    )


def _patch_plan(height: int, width: int) -> str:
    # Each band as fractions of the width and of the height.
    bands = (
        "bands_of(edge, x0, x1, y0, y1) AS (VALUES ('centre', 35e-2, 55e-2, 35e-2, 55e-2), ('left', 0e0, 25e-2, 0e0, 1e0), "
        "('right', 75e-2, 1e0, 0e0, 1e0), ('top', 0e0, 1e0, 0e0, 25e-2), ('bottom', 0e0, 1e0, 75e-2, 1e0)), "
    )

    def span(size: int, axis: str) -> str:
        low, high = f"greatest(r, floor({size} * {axis}0))", f"least({size} - r, floor({size} * {axis}1))"
        return (
            f"(CASE WHEN {low} < {high} THEN {low} ELSE r END)::INTEGER AS {axis}_low, "
            f"(CASE WHEN {low} < {high} THEN {high} ELSE greatest(r + 1, {size} - r) END)::INTEGER AS {axis}_high"
        )

    key = "name || '|' || i || '|'"
    return (
        f"{bands}picked AS (SELECT vec_id, name, i::INTEGER AS i, greatest(5, floor(sqrt(500 / pi())))::INTEGER AS r, "
        f"CASE WHEN i = 0 THEN 'centre' ELSE ['left', 'right', 'top', 'bottom'][{h(key + ' || ' + repr('edge'))} % 4 + 1] "
        f"END AS edge FROM (SELECT *, unnest(range({h('name || ' + repr('|extras'))} % 7 + 1)) AS i FROM grid)), "
        f"bands AS (SELECT *, {span(width, 'x')}, {span(height, 'y')} FROM picked JOIN bands_of USING (edge)), "
        f"patches AS (SELECT vec_id, name, i AS patch, edge, "
        f"(x_low + {h(key + ' || ' + repr('x'))} % (x_high - x_low))::INTEGER AS cx, "
        f"(y_low + {h(key + ' || ' + repr('y'))} % (y_high - y_low))::INTEGER AS cy, r AS radius, "
        f"CASE WHEN {h(key + ' || ' + repr('level'))} % 2 = 1 THEN 255 ELSE 0 END AS level, i AS ord FROM bands)"
    )


def _area_plan(height: int, width: int, amount: str) -> str:
    key = "name || '|' || kind || '|' || i || '|'"
    return (
        f"budgets AS (SELECT *, floor({amount} * ({height} * {width}))::INTEGER AS budget FROM grid), "
        "kinds AS (SELECT vec_id, name, 'salt' AS kind, 255 AS level, floor(6e-1 * budget)::INTEGER AS total FROM budgets "
        "UNION ALL SELECT vec_id, name, 'pepper', 0, budget - floor(6e-1 * budget)::INTEGER FROM budgets), "
        f"drawn AS (SELECT *, unnest(range(1 + {h('name || ' + repr('|') + ' || kind || ' + repr('|patches'))} % 9)) AS i FROM kinds), "
        f"shared AS (SELECT *, {u(key + ' || ' + repr('area'))} AS s FROM drawn), "
        "parts AS (SELECT *, floor(total * s / list_reduce(list(s) OVER "
        "(PARTITION BY vec_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), "
        "lambda a, b: a + b, 0e0))::INTEGER AS part FROM shared), "
        "areas AS (SELECT *, (part + CASE WHEN i = 0 THEN total - sum(part) OVER (PARTITION BY vec_id, kind) ELSE 0 END)::INTEGER "
        "AS area FROM parts), "
        "sized AS (SELECT *, greatest(5, floor(sqrt(area / pi())))::INTEGER AS r FROM areas), "
        "patches AS (SELECT vec_id, name, i::INTEGER AS patch, kind, area, "
        f"(r + {h(key + ' || ' + repr('x'))} % (greatest(r + 1, {width} - r) - r))::INTEGER AS cx, "
        f"(r + {h(key + ' || ' + repr('y'))} % (greatest(r + 1, {height} - r) - r))::INTEGER AS cy, "
        "r AS radius, level, i + CASE WHEN kind = 'pepper' THEN 100 ELSE 0 END AS ord FROM sized)"
    )


def _vertices() -> str:
    key = "name || '|patch|' || patch || '|' || level || '|'"
    return (
        f"counted AS (SELECT *, (5 + {h(key + ' || ' + repr('vertices'))} % 5)::INTEGER AS n FROM patches), "
        "corners AS (SELECT *, unnest(range(n))::INTEGER AS vertex FROM counted), "
        f"angles AS (SELECT *, 2e0 * pi() / n * vertex + {u(key + ' || vertex || ' + repr('|angle'))} * (2e0 * pi() / n) AS angle, "
        f"radius * (5e-1 + {u(key + ' || vertex || ' + repr('|reach'))}) AS reach FROM corners), "
        "vertices AS (SELECT vec_id, name, ord, patch, level, vertex, n, trunc(cx + reach * cos(angle))::INTEGER AS x, "
        "trunc(cy + reach * sin(angle))::INTEGER AS y FROM angles)"
    )


def _noise_summary(plan: str) -> str:
    return (
        f"WITH {LEVELS}, {plan}, {_vertices()}, "
        "edges AS (SELECT a.vec_id, a.ord, a.level, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vertices a "
        "JOIN vertices b ON a.vec_id = b.vec_id AND a.ord = b.ord AND b.vertex = (a.vertex + 1) % a.n), "
        "crossings AS (SELECT vec_id, ord, level, row, x1 + (row + 5e-1 - y1) * (x2 - x1) / (y2 - y1) AS cross_at "
        f"FROM edges, unnest(range({BIG})) t(row) WHERE (y1 > row + 5e-1) <> (y2 > row + 5e-1)), "
        "lines AS (SELECT vec_id, ord, level, row, list(cross_at) AS ats FROM crossings GROUP BY ALL), "
        f"filled AS (SELECT vec_id, row, col, arg_max(level, ord) AS level FROM lines, unnest(range({BIG})) t(col) "
        "WHERE len(list_filter(ats, lambda v: col + 5e-1 < v)) % 2 = 1 GROUP BY vec_id, row, col), "
        f"base AS (SELECT vec_id, row, col, px[(row // {BIG // SIDE}) * {SIDE} + col // {BIG // SIDE} + 1] AS v "
        f"FROM levels, unnest(range({BIG})) r(row), unnest(range({BIG})) c(col)), "
        f"final AS (SELECT b.vec_id, b.row * {BIG} + b.col + 1 AS pos, coalesce(f.level, b.v) AS v FROM base b "
        "LEFT JOIN filled f ON b.vec_id = f.vec_id AND b.row = f.row AND b.col = f.col) "
        "SELECT vec_id, count(*) FILTER (v = 0) AS black, count(*) FILTER (v = 255) AS white, "
        "sum(v * pos)::BIGINT AS weighed FROM final GROUP BY vec_id"
    )


SWEEP = ", ".join(f"{t!r}::DOUBLE" for t in THRESHOLDS)
F1 = (
    "CASE WHEN count(*) FILTER (label = {c}) + count(*) FILTER (pred_class = {c}) > 0 THEN "
    "2e0 * count(*) FILTER (label = {c} AND pred_class = {c}) "
    "/ (count(*) FILTER (label = {c}) + count(*) FILTER (pred_class = {c})) ELSE 0e0 END"
)

ORACLES: dict[str, str] = {
    "label_left_join": f"WITH {JOINED} SELECT name, label FROM joined",
    "label_coverage": f"WITH {JOINED} SELECT count(label) AS labelled, count(*) - count(label) AS unlabelled FROM joined",
    "class_counts": f"WITH {JOINED} SELECT label, count(*) AS n FROM joined GROUP BY label",
    "row_counts": (
        f"WITH {GRID} SELECT count(*) AS n_rows, count(*) FILTER (label = 1) AS n_normal, "
        "count(*) FILTER (label = 0) AS n_abnormal FROM grid"
    ),
    "distinct_labels": "SELECT DISTINCT label FROM embeddings",
    "num_labels": "SELECT count(DISTINCT label) AS num_labels FROM embeddings",
    "filter_class": f"WITH {JOINED} SELECT name, label FROM joined WHERE label = 1",
    "variant_guard_rlike": (
        f"WITH {IMG}, every_row AS (SELECT name FROM img UNION ALL "
        "SELECT regexp_replace(name, '(\\.[^.]*)$', '_flipped\\1') FROM img) "
        "SELECT name FROM every_row WHERE NOT regexp_matches(name, '_flipped\\.[^.]*$')"
    ),
    "rename_suffix": (
        f"WITH {IMG} SELECT name, regexp_replace(name, '(\\.[^.]*)$', '_flipped\\1') AS flipped, "
        "regexp_replace(name, '(\\.[^.]*)$', '_tr\\1') AS transposed, "
        "regexp_replace(name, '(\\.[^.]*)$', '_damaged\\1') AS damaged FROM img"
    ),
    "label_encode": (
        f"WITH {JOINED}, named AS (SELECT name, label, CASE label WHEN 0 THEN 'abnormal' WHEN 1 THEN 'normal' END "
        "AS class_name FROM joined) SELECT name, class_name, "
        "CASE class_name WHEN 'abnormal' THEN 0 WHEN 'normal' THEN 1 END AS class_id, "
        "label::VARCHAR AS label_text, label AS label_back, TRY_CAST(class_name AS INTEGER) AS not_a_number FROM named"
    ),
    "path_rewrite": f"WITH {IMG} SELECT name, regexp_replace(path, '^lake:/', '/lake/') AS path FROM img",
    "path_stem": (
        f"WITH {IMG}, paths AS (SELECT path FROM img UNION ALL SELECT url FROM pages), "
        "bases AS (SELECT path, string_split(path, '/')[-1] AS base FROM paths) "
        "SELECT path, base, regexp_replace(base, '^(.+)\\.[^.]*$', '\\1') AS stem FROM bases"
    ),
    "fenced_json_parse": (
        f"WITH {EVENTS} SELECT name, CASE WHEN event_type = 'error' THEN broken ELSE doc END AS document FROM replies"
    ),
    "label_normalise": (
        f"WITH {EVENTS} SELECT image_name, event_type AS label, notes FROM replies WHERE event_type <> 'error'"
    ),
    "label_failures": f"WITH {EVENTS} SELECT event_type <> 'error' AS ok, count(*) AS n FROM replies GROUP BY ALL",
    "label_failed_names": (
        f"WITH {EVENTS} SELECT image_name, 'reply is not JSON' AS error FROM replies WHERE event_type = 'error'"
    ),
    "bulk_labelling": (
        "WITH sized AS (SELECT 'doc_' || doc_id AS image_name, octet_length(encode(text)) AS n FROM documents) "
        "SELECT image_name, CASE WHEN n % 2 = 0 THEN 'text' END AS label, CASE WHEN n % 2 = 0 THEN n::VARCHAR END AS notes, "
        "n % 2 = 0 AS ok, CASE WHEN n % 2 = 1 THEN 'odd length ' || n END AS error FROM sized"
    ),
    "base64_data_url": (
        "WITH urls AS (SELECT doc_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM documents) "
        "SELECT doc_id, length(url) AS n, md5(url) AS digest FROM urls"
    ),
    "union_variants": (
        f"WITH {IMG} SELECT name, path FROM img UNION ALL "
        "SELECT regexp_replace(name, '(\\.[^.]*)$', '_flipped\\1'), 'n/a' FROM img UNION ALL SELECT name, path FROM img"
    ),
    "union_missing_cols": (
        f"WITH {IMG}, {LAB} SELECT name, path, NULL::INTEGER AS label FROM img UNION ALL SELECT stem, NULL, label FROM lab"
    ),
    "dedup_by_name": (
        f"WITH {IMG}, twice AS (SELECT name, path, s AS source FROM img, (VALUES (0), (1)) t(s)), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, source) AS rn FROM twice) "
        "SELECT name, path, source FROM ranked WHERE rn = 1"
    ),
    "append_new_only": f"WITH {JOINED} SELECT name, path FROM joined WHERE label IS NULL",
    "recent_runs_topk": (
        "SELECT event_id AS run_id, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_time "
        "FROM events ORDER BY ts DESC, event_id LIMIT 5"
    ),
    "experiment_list": "SELECT 'user_' || user_id AS experiment, count(*) AS n_runs FROM events GROUP BY 1",
    "run_lookup": (
        "SELECT 'user_' || user_id AS experiment, event_id AS run_id, event_type AS status, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_time FROM events WHERE user_id = 8"
    ),
    "preview_top_n": (
        f"WITH {GRID} SELECT vec_id, name, label, 8 AS height, 8 AS width FROM grid ORDER BY vec_id LIMIT 5"
    ),
    "image_dims": f"WITH {GRID} SELECT name, 8 AS width, len(g)::INTEGER // 8 AS height FROM grid",
    "class_sample_n": (
        f"WITH {GRID}, ranked AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn "
        "FROM grid) SELECT vec_id, label FROM ranked WHERE rn <= 5"
    ),
    "hash_split": f"WITH {SPLIT} SELECT name, label, split FROM split",
    "stratified_split": (
        f"WITH {GRID}, ranked AS (SELECT name, label, row_number() OVER "
        "(PARTITION BY label ORDER BY md5(name), name) AS rn FROM grid) "
        "SELECT name, label, CASE WHEN (rn - 1) % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM ranked"
    ),
    "split_class_counts": f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY ALL",
    "split_class_sums": (
        f"WITH {SPLIT} SELECT split, count(*) FILTER (label = 0) AS n_abnormal, "
        "count(*) FILTER (label = 1) AS n_normal FROM split GROUP BY split"
    ),
    "variant_fanout": (
        f"WITH {GRID} SELECT regexp_replace(name, '(\\.[^.]*)$', '_tr' || v || '\\1') AS name, 'n/a' AS path, "
        "v::INTEGER AS variant FROM grid, unnest(range(5)) t(v) WHERE label = 0"
    ),
    "class_balance_replicate": (
        f"WITH {REPS} SELECT regexp_replace(name, '(\\.[^.]*)$', '_tr' || v || '\\1') AS name, label, "
        "name AS source_name, v::INTEGER AS variant FROM (SELECT grid.name, grid.label, unnest(range(reps)) AS v "
        "FROM grid JOIN reps USING (label))"
    ),
    "class_balance_exact": (
        f"WITH {REPS}, ranked AS (SELECT name, label, reps, greatest(0, target - reps * n_source) AS missing, "
        "row_number() OVER (PARTITION BY label ORDER BY md5(name), name) AS rn FROM grid JOIN reps USING (label)) "
        "SELECT regexp_replace(name, '(\\.[^.]*)$', '_tr' || v || '\\1') AS name, label, name AS source_name, "
        "v::INTEGER AS variant FROM (SELECT name, label, "
        "unnest(range(reps + CASE WHEN rn <= missing THEN 1 ELSE 0 END)) AS v FROM ranked)"
    ),
    "class_balance_report": f"WITH {REPS} SELECT *, n_source * reps AS n_out FROM reps",
    "stride_sample": (
        f"WITH steps AS (SELECT greatest(1, round_even({FPS}::DOUBLE * 2e0, 0))::BIGINT AS step), "
        "ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS before "
        "FROM events) SELECT user_id, event_id, before // step + 1 AS frame_no, "
        "'frame_' || format('{:03d}', before // step + 1) || '.jpg' AS frame_name FROM ranked, steps WHERE before % step = 0"
    ),
    "stride_by_index": (
        "SELECT conv_id, turn, turn // 2 + 1 AS frame_no, 'frame_' || format('{:03d}', turn // 2 + 1) || '.jpg' "
        "AS frame_name FROM conversations WHERE turn % 2 = 0"
    ),
    "grid_flip_h": _cells(GRID, CELLS, "g[(k // 8) * 8 + (7 - k % 8) + 1]"),
    "grid_flip_v": _cells(GRID, CELLS, "g[(7 - k // 8) * 8 + k % 8 + 1]"),
    "grid_rotate": (
        f"WITH {GRID} SELECT vec_id, degrees, k::INTEGER AS k, round(g[CASE degrees "
        "WHEN 90 THEN (k % 4) * 16 + (15 - k // 4) WHEN 180 THEN 63 - k "
        "ELSE (3 - k % 4) * 16 + k // 4 END + 1], 6) AS value "
        "FROM grid, (VALUES (90), (180), (270)) d(degrees), unnest(range(64)) t(k)"
    ),
    "grid_crop_bias": _crop(
        '(height - least(height, width)) // 2 AS "top", floor((width - least(height, width)) * 4e-1)::INTEGER AS "left"'
    ),
    "grid_crop_center": _crop(
        'round_even((height - least(height, width)) / 2, 0)::INTEGER AS "top", '
        'round_even((width - least(height, width)) / 2, 0)::INTEGER AS "left"'
    ),
    "grid_resize_nearest": _cells(
        GRID, 55,
        "g[(floor((k // 11 + 5e-1) * 8 / 5) * 8 + floor((k % 11 + 5e-1) * 8 / 11))::INTEGER + 1]",
    ),
    "grid_resize_bilinear": _grid_resize(TRIANGLE),
    "grid_resize_cubic": _grid_resize(CUBIC),
    "grid_affine": (
        f"WITH {GRID}, {AFFINE} SELECT vec_id, k::INTEGER AS k, "
        f"round(CASE WHEN seen THEN {_blend('g', 'taps')} ELSE 0e0 END, 6) AS value FROM grid, taps"
    ),
    "pixel_flip_rotate": (
        f"WITH {LEVELS}, turns AS (SELECT unnest({TURNS!r}) AS op) "
        "SELECT vec_id, op, 8 AS height, 8 AS width, k::INTEGER AS k, px[CASE op "
        + " ".join(f"WHEN '{op}' THEN {_turn(op)}" for op in TURNS)
        + " END] AS value FROM levels, turns, unnest(range(64)) t(k)"
    ),
    "pixel_resize_bilinear": _pixel_resize(TRIANGLE),
    "pixel_resize_cubic": _pixel_resize(CUBIC),
    "pixel_affine": (
        f"WITH {LEVELS}, {AFFINE} SELECT vec_id, 8 AS height, 8 AS width, k::INTEGER AS k, "
        f"(CASE WHEN seen THEN floor({_blend('px', 'taps')}) ELSE 0 END)::INTEGER AS value FROM levels, taps"
    ),
    "pixel_crop_resize": (
        f"WITH {LEVELS}, {_weights('w', 4, 6, TRIANGLE)}, "
        f"across AS (SELECT vec_id, y, w.i AS x, {_byte('sum(px[y * 16 + 4 + w.j + 1] * w.q)')} AS v "
        "FROM levels, unnest(range(4)) t(y), w GROUP BY vec_id, y, w.i), "
        f"small AS (SELECT vec_id, w.i * 6 + x AS p, {_byte('sum(v * w.q)')} AS v "
        "FROM across JOIN w ON w.j = y GROUP BY vec_id, w.i, x) "
        "SELECT vec_id, 6 AS height, 6 AS width, (p * 3 + c)::INTEGER AS k, v AS value "
        "FROM small, unnest(range(3)) t(c)"
    ),
    "pixel_augment": _augment(),
    "pixel_salt_pepper": _noise_summary(_patch_plan(BIG, BIG)),
    "pixel_area_noise": _noise_summary(_area_plan(BIG, BIG, "1e-1")),
    "augment_plan": f"WITH {GRID}, {_plan(5)} SELECT name, variant, array_to_string(ops, '>') AS ops FROM plans",
    "noise_patch_plan": (
        f"WITH {GRID}, {_patch_plan(256, 320)} SELECT name, patch, edge, cx, cy, radius, level FROM patches"
    ),
    "noise_polygon_vertices": (
        f"WITH {GRID}, {_patch_plan(256, 320)}, {_vertices()} SELECT name, patch, level, vertex, x, y FROM vertices"
    ),
    "noise_area_budget": (
        f"WITH {GRID}, {_area_plan(256, 320, '1e-2')} SELECT name, patch, kind, area, cx, cy, radius FROM patches"
    ),
    "tensor_rescale": _cells(LEVELS, CELLS, "px[k + 1] / 255e0", table="levels"),
    "tensor_normalise": _cells(LEVELS, CELLS, "(px[k + 1] / 255e0 - 5e-1) / 5e-1", table="levels"),
    "tensor_chw": _cells(GRID, CELLS, "g[(k % 16) * 4 + k // 16 + 1]"),
    "pixel_tensor": (
        f"WITH {LEVELS}, {_weights('w', 8, 12, CUBIC)}, "
        f"across AS (SELECT vec_id, y, w.i AS x, {_byte('sum(px[y * 8 + w.j + 1] * w.q)')} AS v "
        "FROM levels, unnest(range(8)) t(y), w GROUP BY vec_id, y, w.i), "
        f"big AS (SELECT vec_id, w.i * 12 + x AS p, {_byte('sum(v * w.q)')} AS v "
        "FROM across JOIN w ON w.j = y GROUP BY vec_id, w.i, x) "
        f"SELECT vec_id, (c * 144 + p)::INTEGER AS k, round({_unit('v')}, 6) AS value FROM big, unnest(range(3)) t(c)"
    ),
    "image_model_logits": (
        f"WITH {LEVELS}, tensors AS (SELECT vec_id, list_transform(px, lambda v: {_unit('v')}) AS g FROM levels) "
        f"SELECT vec_id, round(3 * {_dot(0)}, 6) AS z0, round(3 * {_dot(1)}, 6) AS z1 FROM tensors"
    ),
    "noisy_names": (
        f"WITH {IMG}, names AS (SELECT name FROM img UNION ALL SELECT url FROM pages) SELECT name, "
        "regexp_replace(name, '^(.*?)(\\.[^./]*)?$', '\\1_noisy\\2') AS noisy FROM names"
    ),
    "score_payload_json": (
        f"WITH {GRID} SELECT vec_id, 1 AS batch, '1x1x8x8' AS shape, k::INTEGER AS k, round(g[k + 1], 6) AS instance, "
        "round(g[k + 1], 6) AS flat FROM grid, unnest(range(64)) t(k)"
    ),
    "score_response_parse": (
        "SELECT event_id, unnest(range(event_id % 3 + 1))::INTEGER AS position, round(value, 6) AS z0, "
        "round(json_extract_string(props, '$.k')::DOUBLE, 6) AS z1 FROM events"
    ),
    "linear_head_logits": f"WITH {SCORED} SELECT vec_id, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM scored",
    "softmax_scores": (
        f"WITH {SCORED} SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p0, 6) AS anomaly_score FROM scored"
    ),
    "predict_class": (
        f"WITH {SCORED} SELECT vec_id, label, pred_class, round(greatest(p0, p1), 6) AS confidence FROM scored"
    ),
    "score_stats": (
        f"WITH {SCORED} SELECT label, count(*) AS n, round(avg(p0), 6) AS mean_score, "
        "round(stddev_pop(p0), 6) AS std_score, round(min(p0), 6) AS min_score, round(max(p0), 6) AS max_score "
        "FROM scored GROUP BY label"
    ),
    "sampled_score_stats": (
        f"WITH {SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM scored) "
        "SELECT label, count(*) AS n, round(avg(p0), 6) AS mean_score, round(stddev_pop(p0), 6) AS std_score, "
        "round(min(p0), 6) AS min_score, round(max(p0), 6) AS max_score FROM ranked WHERE rn <= 50 GROUP BY label"
    ),
    "score_reply": (
        "WITH z AS (SELECT event_id, value / 50e0 AS z0, json_extract_string(props, '$.k')::DOUBLE / 25e0 AS z1 FROM events), "
        "p AS (SELECT event_id, exp(z0 - greatest(z0, z1)) AS e0, exp(z1 - greatest(z0, z1)) AS e1 FROM z) "
        "SELECT event_id, round(e0 / (e0 + e1), 6) AS anomaly_score, CASE WHEN e0 >= e1 THEN 0 ELSE 1 END AS pred_class, "
        "round(greatest(e0, e1) / (e0 + e1), 6) AS confidence FROM p"
    ),
    "score_separation": (
        f"WITH {SCORED}, ends AS (SELECT max(p0) FILTER (label = 1) AS a, min(p0) FILTER (label = 0) AS b FROM scored) "
        "SELECT round(a, 6) AS max_normal, round(b, 6) AS min_abnormal, round(b - a, 6) AS gap, a < b AS separated FROM ends"
    ),
    "threshold_sweep": (
        f"WITH {SCORED}, cuts AS (SELECT unnest([{SWEEP}]) AS threshold), counted AS (SELECT threshold, "
        "count(*) FILTER (label = 0 AND p0 >= threshold) AS true_alarms, "
        "count(*) FILTER (label = 1 AND p0 >= threshold) AS false_alarms, "
        "count(*) FILTER (label = 0 AND p0 < threshold) AS missed, "
        "count(*) FILTER (label = 1 AND p0 < threshold) AS passed FROM scored, cuts GROUP BY threshold) "
        "SELECT *, round(false_alarms / (false_alarms + passed), 6) AS false_positive_rate, "
        "round(missed / (missed + true_alarms), 6) AS false_negative_rate FROM counted"
    ),
    "f1_score": (
        f"WITH {SCORED}, f AS (SELECT count(*) AS n, count(*) FILTER (label = pred_class) / count(*) AS accuracy, "
        f"{F1.format(c=1)} AS f1_normal, {F1.format(c=0)} AS f1_abnormal FROM scored) "
        "SELECT n, round(accuracy, 6) AS accuracy, round(f1_normal, 6) AS f1_normal, "
        "round(f1_abnormal, 6) AS f1_abnormal, round((f1_normal + f1_abnormal) / 2, 6) AS f1_macro FROM f"
    ),
    "confusion_matrix": (
        f"WITH {SCORED} SELECT label, count(*) FILTER (pred_class = 0) AS pred_abnormal, "
        "count(*) FILTER (pred_class = 1) AS pred_normal FROM scored GROUP BY label"
    ),
    "baseline_f1": (
        f"WITH {SPLIT}, prior AS (SELECT CASE WHEN count(*) FILTER (label = 1) > count(*) FILTER (label = 0) "
        "THEN 1 ELSE 0 END AS pred_class FROM split WHERE split = 'train'), "
        "guessed AS (SELECT label, pred_class FROM split, prior WHERE split = 'eval'), "
        "f AS (SELECT count(*) AS n, any_value(pred_class) AS prior_class, "
        f"count(*) FILTER (label = pred_class) / count(*) AS accuracy, {F1.format(c=1)} AS f1_normal, "
        f"{F1.format(c=0)} AS f1_abnormal FROM guessed) "
        "SELECT n, prior_class, round(accuracy, 6) AS accuracy, round(f1_normal, 6) AS f1_normal, "
        "round(f1_abnormal, 6) AS f1_abnormal, round((f1_normal + f1_abnormal) / 2, 6) AS f1_macro FROM f"
    ),
    "stream_score": (
        f"WITH {SCORED} SELECT vec_id, round(p0, 6) AS anomaly_score, pred_class, "
        "round(greatest(p0, p1), 6) AS confidence FROM scored"
    ),
    "anomaly_report": (
        f"WITH {SCORED} SELECT label, count(*) AS n, round(avg(p0), 6) AS mean_score, "
        "round(stddev_pop(p0), 6) AS std_score, round(min(p0), 6) AS min_score, round(max(p0), 6) AS max_score, "
        "count(*) FILTER (label = pred_class) AS n_right FROM scored GROUP BY label"
    ),
}

ORACLES["stratified_split_spread"] = ORACLES["stratified_split"]
ORACLES["stride_sample_spread"] = ORACLES["stride_sample"]
