"""Average linkage in rounds against one merge at a time, silhouettes against the full matrix, and names by lift."""

import random

import numpy as np
import pytest

from manyways.operators import cluster, rationale

R = random.Random(8)
N = 24
#: Likenesses without ties; some pairs have none.
LIKE = {(a, b): round(R.random() * (0.9 if a % 3 == b % 3 else 0.4), 9) for a in range(N) for b in range(a + 1, N) if R.random() < 0.8 and a < 22 and b < 22}


def name(i):
    return f"f{i:02d}"


def frames(spark):
    return spark.createDataFrame([(name(i),) for i in range(N)], "id string"), spark.createDataFrame([(name(a), name(b), s) for (a, b), s in LIKE.items()], "a string, b string, s double")


def matrix():
    d = np.ones((N, N)) - np.eye(N)
    for (a, b), s in LIKE.items():
        d[a, b] = d[b, a] = 1 - s
    return d


def test_rounds_give_the_tree_of_single_merges(spark):
    items, pairs = frames(spark)
    tree = rationale.merges(items, pairs)
    assert tree.count() == N - 1 and tree.filter("height = 1").count() == 2 and tree.agg({"round": "max"}).first()[0] < N / 2
    every = rationale.labelled(items, tree, (3, 4, 7, 12, 24, 30)).collect()
    for k in (3, 4, 7, 12, 24, 30):
        own = {r.id: r.label for r in every if r.k == k}
        got = {frozenset(i for i in own if own[i] == v) for v in own.values()}
        labels = cluster.average_linkage(matrix(), min(k, N))
        assert got == {frozenset(name(i) for i in range(N) if labels[i] == v) for v in set(labels)} and all(min(g) in own.values() for g in got)
    score = {r.k: r for r in rationale.silhouettes(rationale.labelled(items, tree, (3, 5, 9)), pairs).collect()}
    for k in (3, 5, 9):
        labels = cluster.average_linkage(matrix(), k)
        assert score[k].silhouette == pytest.approx(cluster.silhouette(matrix(), labels), abs=1e-6)
        assert (score[k].clusters, score[k].largest, score[k].singletons) == (k, max(np.bincount(labels)), sum(np.bincount(labels) == 1))


def test_clusters_by_families(spark):
    profile = [(f"{g}{i}", fam) for g, fams in (("a", "xy"), ("b", "zw"), ("c", "uv"), ("d", "st")) for i in range(5) for fam in fams] + [("a0", "x"), ("a1", "rare"), (None, "x"), ("e", None)]
    stages = [(f"{g}{i}", "eda" if i else "data") for g in "abcd" for i in range(5)]
    p, s = spark.createDataFrame(profile, "fork string, family string"), spark.createDataFrame(stages, "fork string, stage string")
    rows = {r.label: r for r in rationale.clusters(p, s).collect()}
    assert {k: (r.name, r.n, r.families, r.stage, r.stage_share, r.k, r.silhouette) for k, r in rows.items()} == {f"{g}0": (y, 5, [y, x], "eda", 0.8, 4, 1.0) for g, x, y in (("a", "x", "y"), ("b", "w", "z"), ("c", "u", "v"), ("d", "s", "t"))}
    assert rationale.clusters(p.limit(0), s).count() == 0


def test_lift(spark):
    labels = spark.createDataFrame([(f"f{i}", "one" if i < 4 else "two") for i in range(10)], "id string, label string")
    profile = spark.createDataFrame([(f"f{i}", "often") for i in range(10)] + [("f0", "x"), ("f1", "x"), ("f5", "x"), ("f6", "y")], "fork string, family string")
    got = [(r.label, r.family, r.inside, r.lift, r.rank) for r in rationale.lift(labels, profile).orderBy("label", "rank").collect()]
    assert got == [("one", "x", 2, round(0.5 / 0.3, 6), 1), ("one", "often", 4, 1.0, 2), ("two", "often", 6, 1.0, 1)]


def test_one_task_gives_the_tree_of_joins(spark, monkeypatch):
    """Likenesses of many ties: the rounds in one task merge what those in joins do, and few jobs do it."""
    pairs = spark.createDataFrame([(name(a), name(b), R.choice((0.25, 0.5, 1 / 3, 1.0))) for a in range(8) for b in range(a + 1, 8) if (a + b) % 3], "a string, b string, s double").cache()
    items = spark.createDataFrame([(name(i),) for i in range(9)], "id string")
    tracker, found = spark.sparkContext.statusTracker(), {}
    for dense in (0, 100):
        monkeypatch.setattr(rationale, "DENSE", dense)
        spark.sparkContext.setJobGroup(f"tree-{dense}", "")
        tree = rationale.merges(items, pairs)
        labels = sorted(map(tuple, rationale.labelled(items, tree, (2, 5, 30)).collect()))
        found[dense] = sorted((*r[:3], round(r.height, 9)) for r in tree.collect()), labels, len(tracker.getJobIdsForGroup(f"tree-{dense}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0][:2] == found[100][:2] and 2 * found[100][2] < found[0][2]
