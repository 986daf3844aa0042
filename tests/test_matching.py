"""Order-dependent and resampling operators against brute force and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyways.functions import text
from manyways.operators import ablation, agreement, checks, cluster, forks, geometry, members, resample, review, spans, surrogate


def test_ties_go_to_the_first_seen(spark):
    rows = [(1, "r1", 1, "f", "b"), (2, "r1", 2, "f", "a")]
    m = forks.modal(spark.createDataFrame(rows, "did long, run string, line long, fork string, option string")).collect()
    assert [(r.run, r.option) for r in m] == [("r1", "b")]


def test_one_to_one_as_one_pass_gives_it(spark, tmp_path):
    rng = np.random.default_rng(0)
    pairs = [(int(i), int(j), float(s)) for i in range(12) for j in range(12) if (s := round(rng.random(), 1)) > 0.4]
    left, right, want = set(), set(), []
    for s, i, j in sorted((-s, i, j) for i, j, s in pairs):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.append((i, j))
    got = cluster.one_to_one(spark.createDataFrame(pairs, "i int, j int, s double")).collect()
    assert sorted((r.i, r.j) for r in got) == sorted(want)


def test_matched_levels(spark):
    rows = [("a1", "b1")] * 10 + [("a2", "b2")] * 9 + [("a2", "b3")] + [("a3", "b3")] * 2 + [("a3", "b4")] * 2
    got = {r.level: (r.matched, r.precision) for r in agreement.matched_levels(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert got == {"verbatim": (1, 0.25), "strict": (2, 0.5), "lenient": (3, 0.75), "core": (3, 0.75)}


def test_dense_groups_need_evidence(spark):
    same = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("a", "c", 0.6), ("x", "y", 0.5), ("y", "z", 0.4), ("x", "z", 0.3)]
    edges, apart = spark.createDataFrame(same, "a string, b string, score double"), spark.createDataFrame([("x", "z")], "a string, b string")
    got = {r.id: r.component for r in cluster.dense_groups(edges, apart).collect()}
    # c has half of {a, b}: too little until a-c is read; d has one of three; z is known to differ from x
    assert got["a"] == got["b"] and got["x"] == got["y"] and got.get("z", "z") != "x" and got.get("d") != "a"


def test_nearest_batches(spark):
    options = spark.createDataFrame([("a", 9), ("b", 1), ("c", 5), ("d", 4)], "option string, runs int")
    tokens = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "z")], "option string, token string")
    got = {r.option: r.batch for r in cluster.nearest_batches(options, tokens, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_distance_correlation_of_equal_geometries(spark):
    d = spark.createDataFrame([(1, 2, 0.2), (1, 3, 0.9), (2, 3, 0.5)], "i int, j int, d double")
    assert geometry.distance_correlation(d, d).first().dcor == 1.0 and geometry.mantel(d, d).first().r == 1.0
    null = geometry.relabel_null(d, d, 200).first()
    assert null.value == pytest.approx(1.0) and 1 / 201 <= null.p <= 0.4  # one of six orders, or the mirrored one


def test_zero_overlap_is_distance_one(spark):
    d = spark.createDataFrame([("k1", "r"), ("k2", "s"), ("k2", "t")], "k string, x string")
    assert {(r.i, r.j): r.d for r in geometry.distances(d, "k", "x").collect()} == {("r", "s"): 1.0, ("r", "t"): 1.0, ("s", "t"): 0.0}


def test_label_null_keeps_the_statistic(spark):
    d = spark.createDataFrame([(i, j, 0.1 if (i < 4) == (j < 4) else 0.9) for i in range(8) for j in range(i + 1, 8)], "i int, j int, d double")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "item int, label int")
    r = geometry.label_null(d, labels, 300).first()
    assert r.value == pytest.approx(0.8) and r.p < 0.1 and abs(r.null_mean) < 0.1


def test_ami_by_definition(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{rng.integers(3)}", f"b{rng.integers(4)}") for _ in range(40)]
    n = len(rows)
    a, b = sorted({x for x, _ in rows}), sorted({y for _, y in rows})
    table = np.array([[sum(r == (x, y) for r in rows) for y in b] for x in a])
    ra, cb = table.sum(axis=1), table.sum(axis=0)
    mi = sum(k / n * math.log(n * k / (ra[i] * cb[j])) for (i, j), k in np.ndenumerate(table) if k)
    emi = sum(k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y) for x in map(int, ra) for y in map(int, cb) for k in range(max(1, x + y - n), min(x, y) + 1))
    h = lambda v: -sum(k / n * math.log(k / n) for k in v)
    got = agreement.adjusted_mutual_information(spark.createDataFrame(rows, "a string, b string")).first()
    assert got.ami == pytest.approx((mi - emi) / ((h(ra) + h(cb)) / 2 - emi), abs=1e-6)


@pytest.mark.parametrize(("k", "n"), [(0, 5), (3, 5), (5, 10), (9, 10)])
def test_binomial(spark, k, n):
    pmf = [math.comb(n, i) / 2**n for i in range(n + 1)]
    want = min(1.0, sum(p for p in pmf if p <= pmf[k] + 1e-12))
    d = spark.createDataFrame([(k, n)], "k long, n long")
    assert d.select(review.binomial_p(F.col("k"), F.col("n")).alias("p")).first().p == pytest.approx(want)


def test_auc_counts_ties_half(spark):
    d = spark.createDataFrame([(1, 3.0, True), (2, 2.0, False), (3, 2.0, True), (4, 1.0, False)], "id int, s double, y boolean")
    assert review.auc(d, "s", "y").first().auc == 0.875
    r = checks.auc_null(d, "s", "y", "id", 300).first()
    assert r.auc == 0.875 and 0.2 < r.p <= 1.0


def test_contraction_keeps_clusters_whole(spark):
    rows = [(f"a{i % 7}", f"b{i % 7}") for i in range(70)]
    got = checks.contraction_null(spark.createDataFrame(rows, "a string, b string"), [30, 40], [30, 40], 20).collect()
    assert len(got) == 20 and all(-1 <= r.ari <= 1 for r in got)


def test_recipes_of_independent_choices(spark):
    rows = [(i * 10 + j, f"r{i}", j, f"f{j}", "x" if (i + j) % 2 else "y") for i in range(40) for j in range(3)]
    r = checks.recipes_null(spark.createDataFrame(rows, "did long, run string, line long, fork string, option string"), 200).first()
    assert r.paths == 2 and r.null_mean > 6 and r.p == 0.0


def test_payout_null_and_strengths_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{i}", f, f"l{rng.integers(2)}") for i in range(60) for f in ("f", "g")]
    levels = spark.createDataFrame(rows, "run string, fork string, level string")
    at = {(r, f): l for r, f, l in rows}
    y = spark.createDataFrame([(f"r{i}", float(at[f"r{i}", "f"] == "l1") + 0.01 * i) for i in range(60)], "run string, y double")
    columns, xx, xy, _ = surrogate.moments(levels, y)
    want = {r.fork: r.strength for r in surrogate.strengths(surrogate.attributions(levels, columns, surrogate.ridge(xx, xy, 1.0))).collect()}
    got = {r.fork: r for r in surrogate.payout_null(levels, y, 1.0, 200).collect()}
    assert {f: pytest.approx(r.strength) for f, r in got.items()} == want and got["f"].p < 0.05 < got["g"].p
    boot = {r.fork: r for r in surrogate.bootstrapped(levels, y, 1.0, 100).collect()}
    assert boot["f"].strength == pytest.approx(want["f"], rel=1e-4) and boot["f"].low <= want["f"] <= boot["f"].high


def test_payouts_apply_where_they_can(spark):
    rows = [(f"r{i}", 2.0, 1.0 if i else -1.0, 4.0, "yes") for i in range(40)]
    o = spark.createDataFrame(rows, "run string, or_est double, ci_low double, ci_high double, conclusion string")
    assert surrogate.paid(o, "ci_width").count() == 39 and surrogate.paid(o, "log_or").first().y == pytest.approx(math.log(2))
    assert surrogate.paid(o.limit(20), "verdict").count() == 0
    surrogate.payout("twice")(lambda: F.col("or_est") * 2)
    assert surrogate.paid(o, "twice").first().y == 4.0


def test_thresholds_as_positions_give_them(spark):
    import re

    cases = ["keep > 0 and >= 1", "95% CI at 1.96", "cutoff 2.5 or n = 30, then later on much more text x < 18", "score above 3 below 7", "at 5 at 6", "p < 0.05 > 4 and that is far enough from it >= 8"]

    def want(s):
        out = set()
        for m in re.finditer(text.COMPARISON, s, re.I):
            if re.search(text.DESCRIPTIVE, s[max(0, m.start() - 24) : m.end() + 8], re.I):
                continue
            v = float(m[2])
            out.add(v + (m[1] == ">") - (m[1] == "<") if v.is_integer() else v)
        return sorted(out)

    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.thresholds(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {c: want(c) for c in cases}


def test_escalation_deepens_small_p(spark):
    items = spark.createDataFrame([("x",), ("y",)], "id string")
    seen = []

    def test(some, n):
        seen.append(n)
        return some.select("id", F.when(F.col("id") == "x", 0.01).otherwise(0.5).alias("p"), F.lit(n).alias("draws"))

    got = {r.id: r.draws for r in resample.escalated(test, items, 10, 100, 0.02).collect()}
    assert got == {"x": 100, "y": 10} and seen == [10, 100]


def test_answers_are_accounted_for(spark):
    ids = lambda *x: spark.createDataFrame([("r", i) for i in x], "run string, id long")
    pairs = spark.createDataFrame([("r", 1, -1, "same_option"), ("r", 1, -2, "odd"), ("r", None, -9, None)], "run string, code_id long, prose_id long, verdict string")
    got = {(r.problem, r.n) for r in ablation.answer_errors(pairs, ids(1, 2), ids(-1, -2)).collect()}
    assert got == {("missing code", 1), ("repeated code", 1), ("unknown prose", 1), ("verdict", 1)}


def test_lineage_tags():
    assert members.chain("base.merged.final") == (["base", "merged", "final"], "base (merged, final)")
    assert members.final_tag(["a", "b"], None, "a") == ("a", "") and members.final_tag(["a", "b"], "b", "a")[1]
    with pytest.raises(LookupError):
        members.final_tag(["a"], "c", "a")


def test_text_overlap_without_words(spark):
    d = spark.createDataFrame([(["a"], []), (["a"], ["a", "b"])], "x array<string>, y array<string>")
    assert [r.s for r in d.select(spans.text_overlap(F.col("x"), F.col("y")).alias("s")).collect()] == [None, 0.5]
