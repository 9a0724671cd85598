"""From shared buckets to verified links and classes, without all pairs of a bucket.

Nodes are distinct texts. In every bucket the member of least priority is the centre, and each other member is compared
with it: a bucket of n costs n - 1 pairs. Verified links join nodes into components. Buckets that still hold several
components are looked at again, until no comparison finds a link: small ones member by member, across components; in
larger ones, the members outside the bucket's largest component are compared with one of its members and with one of their
own, both drawn anew in each round, so that buckets of the same members draw the same few. So a link is not lost because its bucket's centre is a third text.

The draws only make components large early. What they leave, the members of larger buckets that still hold several components,
is settled exactly by ``prefix_pairs``, if the caller gives the texts' elements (``elements``): every pair across components that can reach the
threshold is compared, or joined through a third text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescore.llm.scratch import Scratch

# Buckets of at most so many nodes are compared member by member across components.
SMALL = 8
# Classes of buckets that draw alike.
PICKS = 2
# A centre's comparisons are dealt to at most so many groups, each of which gets the centre's payload once.
SPREAD = 256
# Elements that more nodes hold among their first ones are searched by differences from a hub.
HOT = 64


def full_buckets(members: DataFrame) -> DataFrame:
    """(band, key, size, first): members of buckets of two or more, marked if first by a priority that the key alone gives.

    One shuffle by band. A node is in a band once, so a band holds at most one row in (number of bands) of all.
    """
    order = Window.partitionBy("band").orderBy(F.xxhash64("key"), "key")
    return (
        members.withColumn("_last", F.lead("key").over(order)).withColumn("first", F.row_number().over(order) == 1)
        .where(~(F.col("first") & F.col("_last").isNull())).drop("_last")
    )


def star_pairs(members: DataFrame, priority) -> DataFrame:
    """(a, b), distinct: the centre of each bucket, and another member."""
    order = Window.partitionBy("band").orderBy(priority, "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = members.withColumn("a", F.first("key").over(order))
    return stars.where("a <> key").select("a", F.col("key").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame, unpack: Callable[[DataFrame], DataFrame], similarity: Callable, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are at least ``least`` alike.

    ``texts`` is (key, text). ``unpack`` turns rows (key, roles, text), one per node that takes part, into (key, roles) and what
    ``similarity`` compares. A node is then sent to each group that needs it: the groups of a centre are numbered by a hash of its partners, so a centre with a third
    of all nodes as partners is spread over ``SPREAD`` groups. A group is a stream, the centre first.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int").alias("salt"))
    member = dealt.select(F.col("b").alias("key"), F.struct("a", "salt", F.lit(1).alias("role")).alias("r"))
    centre = dealt.select(F.col("a").alias("key"), F.struct("a", "salt", F.lit(0).alias("role")).alias("r")).distinct()
    roles = member.unionByName(centre).groupBy("key").agg(F.collect_list("r").alias("roles"))
    # The same join at every size: what would be broadcast grows with the data.
    ready = unpack(texts.join(roles.hint("merge"), "key").select("key", "roles", "text"))
    payload = [c for c in ready.columns if c not in ("key", "roles")]
    rows = ready.select("key", *payload, F.inline("roles"))
    kind = pairs.schema["a"].dataType.simpleString()

    def run(frames):
        at, one = None, None
        for frame in frames:
            out = []
            for a, salt, role, key, *own in zip(*[frame[c] for c in ["a", "salt", "role", "key", *payload]]):
                if role == 0:
                    at, one = (a, salt), own
                elif at == (a, salt):
                    alike = similarity(one, own)
                    if alike >= least:
                        out.append((a, key, alike))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def hot_first(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` with the node that is in more of them as ``a``.

    A centre's roles are dealt over ``SPREAD`` groups; a partner has one role per centre, and of m pairs no node is the partner in
    more than the square root of 2 m, as each of those centres has as many pairs as it has.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ends = scratch.write(ends, "degrees", narrow=True)
    of = lambda side: ends.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"))
    known = pairs.join(of("a"), "a").join(of("b"), "b")
    turned = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    return known.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, component): the least key of each connected component, for keys that have a link.

    In each round a node takes the least of its own label, its neighbours' labels and its label's label, so long chains halve.
    A round writes one narrow table. Minima are partial before the shuffle, and both sides of each join are plain tables,
    so a node with very many links is split.
    """
    edges = scratch.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges", narrow=True)
    labels = scratch.write(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels", narrow=True)
    while True:
        own = labels.select("u", "label", F.col("label").alias("before"))
        none = F.lit(None).cast(labels.schema["label"].dataType)
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").select("u", "label", none.alias("before"))
        jump = labels.join(labels.select(F.col("u").alias("label"), F.col("label").alias("next")), "label").select("u", F.col("next").alias("label"), none.alias("before"))
        done = scratch.write(own.union(near).union(jump).groupBy("u").agg(F.min("label").alias("label"), F.min("before").alias("before")), "labels", narrow=True)
        labels = done.select("u", "label")
        if done.where("label <> before").limit(1).count() == 0:
            return labels.select(F.col("u").alias("key"), F.col("label").alias("component"))


def prefix_pairs(parts: DataFrame, elements: DataFrame, least: float, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, of two components: pairs of nodes (key, component) whose elements can be ``least`` alike, so that the links among them join all that are.

    ``elements`` is (key, element, weight, total), total being the sum of a node's weights. For measures that are at most
    1 / (1 / s + 1 / t - 1), where s and t are the shares of the two nodes' weights that lie on common elements, and are that
    (the Jaccard similarity) for two plain nodes, all of whose weights are 1. Such a pair's first common element, in any one order of all
    elements, has at most 1 - least of the weight before it on both sides; so only elements that early are joined, and of those only where
    what lies before them on the two sides still allows the bound to reach ``least``. Rare
    elements come first: those of one node alone cost no row, and a node with more than 1 - least of them is compared with none.
    Plain nodes of an element that more than ``hot`` nodes hold so early are not joined by it, but by ``hub_pairs``.
    """
    counted = scratch.write(elements.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("element"))), "counted")
    own = Window.partitionBy("key")
    before = own.orderBy("n", "element").rowsBetween(Window.unboundedPreceding, -1)
    early = counted.withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0))).withColumn("plain", F.max("weight").over(own) == 1).where("n > 1")
    early = early.where(F.col("passed") <= F.col("total") * (1 - least) + 1e-6)
    early = early.select("key", "element", "total", "plain", (1 / (1 - F.col("passed") / F.col("total"))).alias("odds"))
    placed = scratch.write(early.join(parts, "key"), "prefixes")
    # Only elements that several components hold; the members of an element's largest component are not paired with each other.
    sizes = placed.groupBy("element", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("element").agg(F.max(F.struct("size", "component")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("holders")).where("parts > 1")
    mixed = mixed.select("element", F.col("m.component").alias("main"), (F.col("holders") > hot).alias("hot"))
    held = scratch.write(placed.join(mixed, "element"), "prefixes")
    by_hub = F.col("hot") & F.col("plain")
    rest = held.where("component <> main").select("element", F.col("key").alias("a"), F.col("component").alias("ca"), F.col("odds").alias("oa"), by_hub.alias("ha"))
    other = held.select("element", F.col("key").alias("b"), "component", "odds", by_hub.alias("hb"))
    near = (F.col("ca") != F.col("component")) & (F.col("oa") + F.col("odds") <= 1 / least + 1 + 1e-6) & ~(F.col("ha") & F.col("hb"))
    pairs = rest.join(other, "element").where(near).select("a", "b")
    found = held.where(by_hub)
    if found.limit(1).count():
        pairs = pairs.unionByName(hub_pairs(found, counted, least, scratch))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_pairs(held: DataFrame, counted: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(a, b) of two components: pairs of plain nodes that share a row's element in ``held`` (key, component, total, main), as ``prefix_pairs`` takes them.

    Nodes of one ``main`` and of like totals make a group, and one of them is its hub. Two nodes that differ from the hub in nothing in common (no element
    that both have and it has not, or it has and both have not) are no more alike than each of them is like the hub: so each is compared with the hub.
    All others have a first common difference, in the order of rarity, and what lies before it is theirs alone:
    of copies edited each in places of its own that is nearly all, and few such pairs can still reach ``least``.
    """
    step, most = float(np.log(1 / least + 1e-6)), 1 / least + 1 + 1e-6
    # A node is in two ranges of totals, so that two nodes whose totals allow ``least`` have one in common.
    at = F.floor(F.log("total") / step).cast("int")
    members = held.groupBy("main", "key").agg(F.first("component").alias("component"), F.first("total").alias("total"), F.count(F.lit(1)).alias("c"))
    members = scratch.write(members.withColumn("g", F.explode(F.array(at, at + 1))), "members", narrow=True)
    chosen = members.groupBy("main", "g").agg(F.max(F.struct(F.col("component") == F.col("main"), "c", "key", "component")).alias("m"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = scratch.write(chosen.select("main", "g", "size", F.col("m.key").alias("hub"), F.col("m.component").alias("hc")), "hubs", narrow=True)
    stars = members.join(hubs, ["main", "g"]).where("component <> hc").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    # Each node to its group's task, in as many parts as ``verify`` makes, the hub first in each.
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SPREAD)).cast("int"))
    first = dealt.select("main", "g", "salt").distinct().join(hubs, ["main", "g"]).select("main", "g", "salt", F.col("hub").alias("key"), F.col("hc").alias("component"), "size")
    roles = dealt.select("main", "g", "salt", "key", "component", F.lit(None).cast("bigint").alias("size")).unionByName(first)
    sets = counted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("element", "n"))).alias("s")).select("key", F.col("s.element").alias("elements"), F.col("s.n").alias("counts"))
    rows = sets.join(roles.hint("merge"), "key").repartition("main", "g", "salt").sortWithinPartitions("main", "g", "salt", F.col("size").asc_nulls_last())
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}

    def run(frames):
        group, hub = None, None
        for frame in frames:
            out = []
            for main, g, salt, key, part, size, own, counts in zip(*[frame[c] for c in ("main", "g", "salt", "key", "component", "size", "elements", "counts")]):
                x, n = np.asarray(own), np.asarray(counts)
                if size == size and size is not None:
                    group, hub = (main, g, salt), (x, n, size)
                    continue
                if group != (main, g, salt):
                    continue
                lacks = ~np.isin(hub[0], x, assume_unique=True)
                adds = ~np.isin(x, hub[0], assume_unique=True)
                element = np.concatenate([x[adds], hub[0][lacks]])
                missing = np.arange(len(element)) >= adds.sum()
                # Nodes of the group that have the difference: of an element that most hold, those that lack it.
                rarity = np.concatenate([n[adds], np.maximum(2, hub[2] - hub[1][lacks])])
                order = np.lexsort((element, missing, rarity))
                element, missing, rarity = element[order], missing[order], rarity[order]
                lack = np.cumsum(missing) - missing
                add = np.arange(len(element)) - lack
                # A partner has at most 1 / least times as many elements.
                keep = (_odds(add, len(x)) + _odds(least * lack, len(x)) <= most) & (rarity > 1)
                every = int(adds.sum()), int(lacks.sum())
                out += [(main, g, key, part, len(x), *every, *d) for d in zip(element[keep].tolist(), missing[keep].tolist(), add[keep].tolist(), lack[keep].tolist())]
            yield pd.DataFrame(out, columns=["main", "g", "key", "component", "total", "all_adds", "all_lacks", "element", "missing", "adds", "lacks"])

    schema = f"main {kinds['main']}, g int, key {kinds['key']}, component {kinds['component']}, total bigint, all_adds bigint, all_lacks bigint, element bigint, missing boolean, adds bigint, lacks bigint"
    found = scratch.write(rows.mapInPandas(run, schema), "differences")
    # A difference is a key if some node of the group outside ``main`` and one of another component can meet there.
    key = ["main", "g", "element", "missing"]
    outside = F.col("component") != F.col("main")
    bounds = found.groupBy(*key).agg(
        *[F.min(c).alias(f"{c}_any") for c in ("adds", "lacks")], *[F.min(F.when(outside, F.col(c))).alias(f"{c}_out") for c in ("adds", "lacks")], F.count(F.lit(1)).alias("holders")
    ).where("holders > 1 AND adds_out IS NOT NULL")
    least_of = lambda c: F.when(outside, F.col(f"{c}_any")).otherwise(F.col(f"{c}_out"))
    meets = _meet(F.col("adds") + least_of("lacks"), F.col("total"), least * (F.col("lacks") + least_of("adds")), F.col("total"), most)
    sums = ["total", "all_adds", "all_lacks", "adds", "lacks"]
    live = scratch.write(found.join(bounds, key).where(meets).select(*key, "key", "component", *sums), "differences")
    rest = live.where(outside).select(*key, F.col("key").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in sums])
    other = live.select(*key, F.col("key").alias("b"), "component", *sums)
    # The differences of one kind in common are no more than either node has left.
    left = lambda c: F.least(F.col(f"a_all_{c}") - F.col(f"a_{c}"), F.col(f"all_{c}") - F.col(c))
    common = left("adds") + left("lacks")
    apart = F.col("a_all_adds") + F.col("all_lacks") - common, F.col("a_total"), F.col("all_adds") + F.col("a_all_lacks") - common, F.col("total")
    near = (F.col("ca") != F.col("component")) & _meet(*apart, most)
    return stars.unionByName(rest.join(other, key).where(near).select("a", "b"))


def _odds(own: np.ndarray, total: int) -> np.ndarray:
    """1 / the share that is left of ``total`` without ``own``."""
    return np.divide(total, total - own, out=np.full(len(own), np.inf), where=own < total)


def _meet(one, total, other, its, most: float):
    """Whether two nodes can be alike with at least ``one`` of ``total`` elements, and ``other`` of ``its``, not in common."""
    return (one < total) & (other < its) & (F.try_divide(total, total - one) + F.try_divide(its, its - other) <= most)


def link_all(
    members: DataFrame, read_texts: Callable[[DataFrame], DataFrame], unpack: Callable, similarity: Callable, least: float, scratch: Scratch,
    elements: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, similarity), components (key, component)) of nodes that share buckets (band, key).

    ``read_texts`` gives (key, text) for a table of keys. It is called once, for the nodes that share a bucket, and written.
    ``elements`` turns (key, text) into what ``prefix_pairs`` takes; without it, larger buckets are searched by draws alone.
    """
    held = scratch.write(full_buckets(members), "buckets").select("band", "key")
    texts = scratch.write(read_texts(held.select("key").distinct()), "texts")
    tested = scratch.write(star_pairs(held, F.xxhash64("key")), "pairs", narrow=True)
    links = scratch.write(verify(tested, texts, unpack, similarity, least), "links")
    named = components(links, scratch)
    turn = 0
    while True:
        turn += 1
        seen = held.join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
        # Whether a bucket holds several components is a comparison of two bounds, partial before the shuffle.
        mixed = seen.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("band", "n")
        open_rows = scratch.write(seen.join(mixed, "band"), "open", narrow=True)
        small = open_rows.where(F.col("n") <= SMALL).select("band", "key", "component")
        other = small.select("band", F.col("key").alias("b"), F.col("component").alias("cb"))
        pairs = small.join(other, "band").where("component <> cb AND key < b").select(F.col("key").alias("a"), "b")
        large = open_rows.where(F.col("n") > SMALL)
        stars = _stragglers(large, turn)
        known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        # A drawn member stays the centre of its pairs: its comparisons are dealt by ``verify``, and a partner has a role for each draw only.
        lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
        found = pairs.union(stars).groupBy(lo, hi).agg(F.min("a").alias("a")).join(known.toDF("lo", "hi"), ["lo", "hi"], "left_anti")
        fresh = scratch.write(found.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "pairs", narrow=True)
        more = scratch.write(verify(fresh, texts, unpack, similarity, least), "links")
        n_more = more.count()
        if n_more == 0:
            break
        named = _merge(named, more, scratch)
        # All pairs of small buckets are tested now; and a bucket of one component stays one.
        tested, links, held = tested.unionByName(fresh), links.unionByName(more), large.select("band", "key")
        # Where the rest is settled exactly, draws go on only while one in a hundred finds something.
        if elements is not None and 100 * n_more < fresh.count():
            large = held.join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
            split = large.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
            large = large.join(split, "band")
            break
    # Components have not changed since ``large`` was written.
    left = scratch.write(large.select("key", "component").distinct(), "left", narrow=True)
    if elements is None or left.limit(1).count() == 0:
        return links, named
    found = prefix_pairs(left, scratch.write(elements(texts.join(left.select("key"), "key").select("key", "text")), "elements"), least, scratch)
    known = tested.unionByName(fresh).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = scratch.write(found.join(known, ["a", "b"], "left_anti"), "pairs", narrow=True)
    fresh = scratch.write(hot_first(found, scratch), "pairs", narrow=True)
    more = scratch.write(verify(fresh, texts, unpack, similarity, least), "links")
    if more.limit(1).count() == 0:
        return links, named
    return links.unionByName(more), _merge(named, more, scratch)


def _stragglers(large: DataFrame, turn: int) -> DataFrame:
    """(a, b) of large buckets, a the drawn one: members outside the largest component, with one inside it and one of their own.

    Sizes and picks are aggregates, partial before the shuffle; at most two pairs a bucket's member. Priorities depend on one of
    ``PICKS`` classes of buckets, not on the bucket: texts that share most buckets are compared a few times a round, not in each.
    """
    pick = F.struct(F.xxhash64("key", F.lit(turn), F.pmod(F.xxhash64("band"), F.lit(PICKS))).alias("p"), "key")
    parts = large.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size"), F.min(pick).alias("pick"))
    main = parts.groupBy("band").agg(F.max(F.struct("size", F.col("component"), "pick")).alias("m"))
    main = main.select("band", F.col("m.component").alias("main"), F.col("m.pick.key").alias("inside"))
    rest = large.join(main, "band").where("component <> main")
    own = rest.groupBy("band").agg(F.min(pick).alias("o"), F.min_by("component", pick).alias("co")).select("band", F.col("o.key").alias("own"), "co")
    both = rest.join(own, "band")
    pairs = both.select(F.explode(F.array(F.col("inside"), F.when(F.col("co") != F.col("component"), F.col("own")))).alias("a"), F.col("key").alias("b"))
    return pairs.where("a IS NOT NULL")


def _merge(named: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after further links, which join components: solved on the graph of components alone."""
    names = lambda side: named.select(F.col("key").alias(side), F.col("component").alias(f"c{side}"))
    sides = more.join(names("a"), "a", "left").join(names("b"), "b", "left")
    sides = scratch.write(sides.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "joins", narrow=True)
    merged = components(sides.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch).withColumnRenamed("key", "old").withColumnRenamed("component", "new")
    alone = sides.select(F.col("a").alias("key"), F.col("ca").alias("component")).union(sides.select("b", "cb")).where("key = component")
    every = named.unionByName(alone).distinct()
    joined = every.join(merged, F.col("component") == F.col("old"), "left")
    return scratch.write(joined.select("key", F.coalesce("new", "component").alias("component")), "named", narrow=True)
