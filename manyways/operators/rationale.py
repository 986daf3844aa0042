"""Rationale clusters: forks grouped by the families of their rationale tags, how many groups, and what names them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyways.operators.cluster import cut, stored

LEAST_FORKS = 3
KS = range(4, 13)
#: So many items' tree is made in one task, over a matrix of their likenesses (512 MB); a larger one in joins, a few a round.
DENSE = 8192


def coordinates(profile: DataFrame, least: int = LEAST_FORKS) -> DataFrame:
    """profile (fork, family) of the families that at least `least` forks have, without repeats."""
    rows = profile.select("fork", "family").dropna().distinct()
    return rows.join(rows.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("family"), "family", "left_semi").select("fork", "family")


def likeness(profile: DataFrame) -> DataFrame:
    """a < b, s: the Jaccard similarity of forks that share a family; all others have 0."""
    n = profile.groupBy("fork").agg(F.count("*").alias("n"))
    of = lambda s: profile.select("family", F.col("fork").alias(s)).join(n.select(F.col("fork").alias(s), F.col("n").alias(f"n{s}")), s)
    both = of("a").join(of("b"), "family").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return both.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("s"))


def merges(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """round, a, b, height: the tree of average linkage over items (id) with pairs (a < b, s: similarity; pairs that aren't there have 0),
    by rounds of reciprocal nearest neighbours. b joins a, height is the mean distance 1 - s between both.

    Average linkage is reducible: two clusters that are each other's nearest stay so whatever else merges, so a round merges all such pairs
    at once and gives the same tree as one merge at a time. Distances are kept as sums of similarities of clusters that have any, in
    joins; ties go to the pair of the smallest names, an order in which the nearest pair of all is always mutual. Clusters without any
    likeness have distance 1 and join the smallest name last, in the order of names. Up to DENSE items the same rounds run in one task.
    """
    ids = stored(items.select("id").distinct())
    if ids.count() <= DENSE:
        return dense_merges(ids, pairs)
    size = stored(items.select("id").distinct().withColumn("n", F.lit(1).cast("long")))
    sums = stored(pairs.select("a", "b", "s"))
    found, number = [], 0
    while sums.limit(1).count():
        number += 1
        n = lambda s, size=size: size.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"))
        mean = sums.join(n("a"), "a").join(n("b"), "b").select("a", "b", (1 - F.col("s") / (F.col("na") * F.col("nb"))).alias("height"))
        order = F.struct(F.round("height", 12).alias("h"), "a", "b", "height")
        both = mean.select(F.col("a").alias("id"), order.alias("o")).union(mean.select(F.col("b").alias("id"), order.alias("o")))
        best = both.groupBy("id").agg(F.min("o").alias("o"))
        mutual = best.groupBy("o").agg(F.count("*").alias("k")).filter("k = 2").select(F.lit(number).alias("round"), "o.a", "o.b", "o.height")
        mutual = stored(mutual)
        found.append(mutual)
        into = mutual.select(F.col("b").alias("id"), F.col("a").alias("to"))
        renamed = lambda d, c, into=into: d.join(into.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        size = stored(renamed(size, "id").groupBy("id").agg(F.sum("n").alias("n")))
        moved = renamed(renamed(sums, "a"), "b").filter("a <> b")
        sums = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s").groupBy("a", "b").agg(F.sum("s").alias("s")))
    rest = size.select(F.lit(number + 1).alias("round"), F.min("id").over(Window.partitionBy()).alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("height")).filter("a <> b")  # a vocabulary
    out = rest
    for m in found:
        out = out.union(m)
    return cut(out)


def rounds(s: np.ndarray):
    """round, a, b, height: the rounds of merges() over a matrix of summed similarities, items in order of names; s is used up."""
    n, number = np.ones(len(s)), 0
    np.fill_diagonal(s, 0)
    best, height = np.full(len(s), -1), np.full(len(s), np.inf)

    def look(i: int) -> None:
        """i's nearest by rounded height, then by the pair of names."""
        at = np.flatnonzero(s[i])
        if not len(at):
            best[i], height[i] = -1, np.inf
            return
        h = np.round(1 - s[i, at] / (n[i] * n[at]), 12)
        least = at[h == h.min()]
        best[i], height[i] = least[0], h.min()  # of pairs with i the one with the smallest other name is the smallest

    for i in range(len(s)):
        look(i)
    while True:
        a = np.flatnonzero(best >= 0)
        a = a[(best[best[a]] == a) & (a < best[a])]
        if not len(a):
            return
        number += 1
        b = best[a]
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            yield number, i, j, float(1 - s[i, j] / (n[i] * n[j]))
        into = np.arange(len(s))
        into[b] = a
        s[a] += s[b]
        s[b] = 0
        s[:, a] += s[:, b]
        s[:, b] = 0
        s[a, a] = 0
        n[a] += n[b]
        n[b] = 0
        best[b] = -1
        changed = np.zeros(len(s), bool)
        changed[a] = changed[b] = True
        stale = (n > 0) & (changed | ((best >= 0) & changed[best]))
        for i in np.flatnonzero(stale).tolist():
            look(i)
        others = np.flatnonzero((n > 0) & ~stale)
        for k in a.tolist():  # what has grown may have come nearer by rounding
            own = others[s[others, k] > 0]
            h = np.round(1 - s[own, k] / (n[own] * n[k]), 12)
            nearer = (h < height[own]) | ((h == height[own]) & (k < best[own]))
            best[own[nearer]], height[own[nearer]] = k, h[nearer]


def dense_merges(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """merges() of ids (id, distinct) in one task."""
    kind = ids.schema["id"].dataType.simpleString()
    names = ids.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("s")).union(pairs.select("a", "b", "s"))

    def tree(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches))
        name, at = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
        a, b = at[: len(found)], at[len(found) :]
        s = np.zeros((len(name), len(name)))
        np.add.at(s, (a, b), found["s"].to_numpy())
        s += s.T
        out = [*rounds(s)]
        left = sorted({*range(len(name))} - {j for _, _, j, _ in out})
        out += [(1 + max((r for r, *_ in out), default=0), left[0], j, 1.0) for j in left[1:]]
        number, i, j, height = (np.array(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(name[np.array(i, int)], found.schema.field("a").type), pa.array(name[np.array(j, int)], found.schema.field("a").type), pa.array(height, pa.float64())], ["round", "a", "b", "height"])

    return stored(names.groupBy(F.lit(0).alias("all")).applyInArrow(tree, f"round int, a {kind}, b {kind}, height double"))


def labelled(items: DataFrame, tree: DataFrame, ks=KS) -> DataFrame:
    """k, id, label: each k's clusters after the lowest merges that leave k of them, ties by round and names; the label is the smallest name.
    Where there are fewer items than k each is a cluster."""
    ids = items.select("id").distinct()
    n = ids.count()
    place = F.row_number().over(Window.orderBy(F.round("height", 12), "round", "b"))  # a vocabulary: as many merges as items
    steps = stored(tree.select("a", "b", place.alias("place")))
    if n <= DENSE:
        return dense_labels(ids, steps, n, [*ks])
    want = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    now = ids.select(want, "id", F.col("id").alias("label"))
    kept = stored(ids.sparkSession.range(1).select(want).join(steps, F.col("place") <= n - F.col("k")).select("k", F.col("b").alias("label"), F.col("a").alias("to")))
    while True:  # b always is the larger name of two clusters' smallest, so labels fall until they are the smallest
        after = cut(now.join(kept, ["k", "label"], "left").select("k", "id", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")))
        now = after.select("k", "id", "label")
        if not after.filter("moved").limit(1).count():
            return now


def dense_labels(ids: DataFrame, steps: DataFrame, n: int, ks: list[int]) -> DataFrame:
    """labelled() of n ids by steps (a, b, place) in one task."""
    kind = ids.schema["id"].dataType.simpleString()
    rows = ids.select(F.lit(0).cast("int").alias("place"), F.col("id").alias("a"), F.col("id").alias("b")).union(steps.select("place", "a", "b"))

    def each(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches)).sort_by("place")
        place, a, b = (found[c].to_pylist() for c in ("place", "a", "b"))
        for k in ks:
            label: dict = {}
            to = {y: x for p, x, y in zip(place, a, b, strict=True) if 0 < p <= n - k}  # a name is taken in once
            own = sorted(x for p, x in zip(place, a, strict=True) if not p)
            for x in own:  # names fall on their way, so what x joins has its label
                label[x] = label[to[x]] if x in to else x
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array(own, found.schema.field("a").type), pa.array([*label.values()], found.schema.field("a").type)], ["k", "id", "label"])

    return rows.groupBy(F.lit(0).alias("all")).applyInArrow(each, f"k int, id {kind}, label {kind}")


def silhouettes(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """k, silhouette, clusters, largest, singletons: over labels (k, id, label) and pairs (a < b, s). A cluster of one counts 0."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "s").union(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "s"))
    sizes = labels.groupBy("k", "label").agg(F.count("*").alias("n"))
    of_other = labels.select("k", F.col("id").alias("other"), F.col("label").alias("near"))
    sums = both.join(of_other, "other").groupBy("k", "id", "near").agg(F.sum("s").alias("s")).join(sizes.select("k", F.col("label").alias("near"), F.col("n").alias("nn")), ["k", "near"])
    t = labels.join(sums, ["k", "id"], "left")
    own, far = F.col("near") == F.col("label"), F.col("near") != F.col("label")
    per = t.groupBy("k", "id", "label").agg(F.coalesce(F.max(F.when(own, F.col("s"))), F.lit(0.0)).alias("inside"), F.min(F.when(far, 1 - F.col("s") / F.col("nn"))).alias("nearest"))
    per = per.join(sizes, ["k", "label"]).join(sizes.groupBy("k").agg(F.count("*").alias("clusters")), "k")
    a = 1 - F.col("inside") / (F.col("n") - 1)
    b = F.when(F.col("clusters") > 1, F.coalesce("nearest", F.lit(1.0))).otherwise(F.lit(0.0))  # a cluster without any likeness is at distance 1
    wide = F.greatest(a, b)
    s = F.when(F.col("n") < 2, 0.0).when(wide > 0, (b - a) / wide).otherwise(0.0)
    one = per.groupBy("k").agg(F.round(F.avg(s), 6).alias("silhouette"))
    return one.join(sizes.groupBy("k").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons")), "k")


def lift(labels: DataFrame, profile: DataFrame) -> DataFrame:
    """label, family, inside, lift, rank: families that are over-represented in a cluster (id, label), those that two of its forks and three
    in ten have; by how much more often than over all forks, ties to the larger name."""
    members = labels.select(F.col("id").alias("fork"), "label")
    total = members.agg(F.count("*").alias("total"))
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    own = profile.join(members, "fork")
    base = own.groupBy("family").agg(F.count("*").alias("everywhere"))
    t = own.groupBy("label", "family").agg(F.count("*").alias("inside")).join(sizes, "label").join(base, "family").crossJoin(F.broadcast(total))  # one row
    t = t.filter(F.col("inside") >= F.greatest(F.lit(2.0), 0.3 * F.col("n"))).withColumn("lift", F.round(F.col("inside") / F.col("n") / (F.col("everywhere") / F.col("total")), 6))
    return t.select("label", "family", "inside", "lift", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("lift"), F.desc("family"))).cast("int").alias("rank"))


def clusters(profile: DataFrame, stages: DataFrame, least: int = LEAST_FORKS, ks=KS) -> DataFrame:
    """label, name, n, families, stage, stage_share, k, silhouette: forks clustered by their families with the k of the best silhouette (the
    smallest of equals), each cluster named by the family of the highest lift (`mixed` without one), the four highest, and its most
    frequent stage (fork, stage; ties by name)."""
    kept = stored(coordinates(profile, least))
    items, pairs = kept.select(F.col("fork").alias("id")).distinct(), stored(likeness(kept))
    every = stored(labelled(items, merges(items, pairs), ks))
    best = silhouettes(every, pairs).orderBy(F.desc("silhouette"), "k").limit(1).select("k", "silhouette")
    labels = every.join(F.broadcast(best), "k")  # one row
    families = lift(labels, kept).filter("rank <= 4").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "family"))), lambda x: x["family"]).alias("families"))
    at = labels.select(F.col("id").alias("fork"), "label").join(stages, "fork", "left").groupBy("label", "stage").agg(F.count("*").alias("c"))
    most = at.groupBy("label").agg(F.max_by("stage", F.struct("c", F.col("stage").isNotNull(), "stage")).alias("stage"), F.max("c").alias("c"))
    t = labels.groupBy("label", "k", "silhouette").agg(F.count("*").alias("n")).join(most, "label").join(families, "label", "left")
    return t.select("label", F.coalesce(F.get("families", F.lit(0)), F.lit("mixed")).alias("name"), "n", F.coalesce("families", F.array().cast("array<string>")).alias("families"), "stage", F.round(F.col("c") / F.col("n"), 2).alias("stage_share"), "k", "silhouette")
