"""Closed-form cases of the core operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from manyways.functions import stats, text
from manyways.operators import agreement, audit, cluster, forks, resample, sequence, spans, surrogate


def choice(spark, rows):
    return spark.createDataFrame([(i, r, "x", i, f, o) for i, (r, f, o) in enumerate(rows)], "did long, run string, arm string, line long, fork string, option string")


def test_effective_options(spark):
    rows = [(f"r{i}", "f", "a" if i < 95 else "b") for i in range(100)]
    s = forks.fork_stats(choice(spark, rows)).first()
    assert (s.reach, s.absent, round(s.eff_reached, 3), round(s.eff_all, 3), s.modal_share) == (100, 0, 1.105, 1.105, 0.95)


def test_absent_is_a_level(spark):
    rows = [(f"r{i}", "f", f"o{i}") for i in range(6)] + [(f"r{i}", "g", "x") for i in range(200)]
    s = {r.fork: r for r in forks.fork_stats(choice(spark, rows)).collect()}
    assert s["f"].eff_reached == 6.0 and round(s["f"].eff_all, 3) == 1.063


def test_one_vote_a_run(spark):
    m = forks.modal(choice(spark, [("r1", "f", "b"), ("r1", "f", "a"), ("r1", "f", "a")])).collect()
    assert [(r.run, r.option) for r in m] == [("r1", "a")]


def test_rarefaction(spark):
    d = spark.createDataFrame([("f", 1), ("f", 3)], "g string, c int")
    assert [(r.k, r.expected) for r in stats.rarefaction(d, "g", "c", [2, 9]).orderBy("k").collect()] == [(2, 1.5), (9, 2.0)]


def test_fisher(spark):
    d = spark.createDataFrame([(3, 3, 3, 6)], "hit int, n1 int, hits int, n int")
    assert stats.fisher_tail(d, "hit", "n1", "hits", "n").first().p == pytest.approx(0.05)


def test_ln_factorial_meets_lgamma(spark):
    import math

    d = spark.range(0, 400, 7)
    for r in d.select("id", stats.ln_factorial(F.col("id")).alias("x")).collect():
        assert r.x == pytest.approx(math.lgamma(r.id + 1), abs=1e-9)


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.03, 0.5)], "p double")
    assert stats.benjamini_hochberg(d, "p").first().threshold == 0.03


def test_returns_and_routes(spark):
    rows = [(1, "r", "x", 1, "A", "o", 4), (2, "r", "x", 10, "B", "o", 2), (3, "r", "x", 11, "C", "o", 1)]
    c = spark.createDataFrame(rows, "did long, run string, arm string, line long, fork string, option string, rank int")
    assert [(r.did, r.depth, r.distance) for r in sequence.returns(c).collect()] == [(1, 2, 9)]
    assert sorted((r.a, r.b) for r in sequence.routes(c).collect()) == [("A", "B"), ("B", "C"), ("C", "A")]


def test_islands(spark):
    c = spark.createDataFrame([(i, "r", "f", "o", l) for i, l in enumerate((3, 6, 40))], "did long, run string, fork string, option string, line long")
    assert [r.occurrence for r in sequence.islands(c).orderBy("did").collect()] == [0, 0, 1]


@pytest.mark.parametrize(("a", "b", "ari"), [("1122", "1122", 1.0), ("1122", "1212", -0.5)])
def test_ari(spark, a, b, ari):
    d = spark.createDataFrame([*zip(a, b, strict=True)], "a string, b string")
    assert agreement.adjusted_rand(d).first().ari == ari


def test_b_cubed(spark):
    d = spark.createDataFrame([*zip("1122", "1111", strict=True)], "a string, b string")
    r = agreement.b_cubed(d).first()
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_text(spark):
    d = spark.createDataFrame([("age > 0", "[1.0]"), ("n >= 1", "[1.0]"), ("95% CI at 1.96", "[]")], "t string, want string")
    assert all(str(r.got) == r.want for r in d.select("want", text.thresholds(F.col("t")).alias("got")).collect())
    r = spark.range(1).select(text.norm_target(F.lit("df_height_log")).alias("n"), text.fork_handle(F.lit("x")).alias("h")).first()
    assert r.n == "height" and r.h == "fork:11f6ad8e"


def test_spans(spark):
    a = spark.createDataFrame([("r", 0, 1, 10)], "run string, id long, start long, end long")
    b = spark.createDataFrame([("r", 0, 2, 11)], "run string, id long, start long, end long")
    o = spans.overlaps(a, b)
    assert [(r.n, r.jitter) for r in o.collect()] == [(9, 2)]
    assert spans.f1(spans.greedy(o, "jaccard", 0.5), a, b).first().f1 == 1.0
    p = spans.partition_audit(a, spark.createDataFrame([("r", 12), ("s", 3)], "run string, n int"))
    assert {r.run: r.gaps for r in p.collect()} == {"r": 2, "s": 3}


def test_vetoed_groups(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], "a string, b string, score double")
    v = spark.createDataFrame([("a", "c")], "a string, b string")
    assert {r.id: r.component for r in cluster.vetoed_groups(e, v).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_average_linkage():
    x = np.array([0.0, 0.1, 5.0, 5.2, 9.0])
    d = abs(x[:, None] - x[None, :])
    assert cluster.average_linkage(d, 3).tolist() == [0, 0, 1, 1, 2]
    assert cluster.silhouette(d, np.array([0, 0, 1, 1, 2])) > 0.5


def test_curveball_keeps_margins():
    p = pd.DataFrame([(r, c) for r in range(8) for c in range(8) if (r * 3 + c * 5) % 4 < 2], columns=["r", "c"])
    q = resample.curveball(p, "r", "c", 200)
    assert p.groupby("r").size().equals(q.groupby("r").size()) and p.groupby("c").size().equals(q.groupby("c").size()) and not p.equals(q)


def test_permutation_keeps_groups(spark):
    d = spark.createDataFrame([(i, i % 2, i) for i in range(20)], "k int, g int, v int").withColumn("draw", F.lit(0))
    r = resample.permuted(d, "v", ["g"], "k").collect()
    assert all(x.v % 2 == x.g for x in r) and sorted(x.v for x in r) == list(range(20)) and any(x.v != x.k for x in r)


def test_ridge_meets_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", f, f"l{rng.integers(3)}") for i in range(60) for f in ("f", "g")]
    levels = spark.createDataFrame(rows, "run string, fork string, level string")
    y = {f"r{i}": float(rng.normal()) for i in range(60)}
    columns, xx, xy, n = surrogate.moments(levels, spark.createDataFrame([*y.items()], "run string, y double"))
    at = {(r, f): l for r, f, l in rows}
    x = np.array([[1.0] + [float(at[r, f] == l) for f, l in columns] for r in y])
    assert n == 60 and np.allclose(xx, x.T @ x) and np.allclose(xy, x.T @ np.array([*y.values()]))


def test_audit_contract(spark):
    with pytest.raises(ValueError):
        audit.judged("x", "claim", False, {}, "")
    assert audit.judged("x", "claim", True, {}, "all", uses=("a",), built_from=("a",)).verdict == audit.INFO
