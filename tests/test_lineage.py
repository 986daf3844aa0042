"""The similarity join against all pairs, and rules of the lineage audit."""

import random

import pytest

from manyways.operators import lineage, setjoin


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("least", [0.2115, 0.4, 0.55, 0.6, 0.8, 1.0])
def test_join_of_alike_sets_by_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    word = lambda: f"t{int(r.paretovariate(0.7)) % 30}"  # noqa: E731  some tokens are in most sets
    sets = [(g, f"s{i}", sorted({word() for _ in range(r.randint(0, 12))})) for g in "xy" for i in range(70)]
    sets += [("x", "same1", ["t1", "t2", "t3"]), ("x", "same2", ["t3", "t2", "t1"]), ("x", "null", None)]
    df = spark.createDataFrame([*sets, sets[3]], "g string, key string, tokens array<string>")
    got = {(x.g, x.a, x.b): (x.k, x.na, x.nb) for x in setjoin.similar_sets(df, "key", "tokens", least, ("g",)).collect()}
    own = [(g, k, {*t}) for g, k, t in sets if t]
    want = {(g, a, b): (len(s & t), len(s), len(t)) for g, a, s in own for h, b, t in own if g == h and a < b and jaccard(s, t) >= least}
    assert got == want and got
    flat = setjoin.similar_sets(df.filter("g = 'y'").drop("g"), "key", "tokens", least)
    assert {(x.a, x.b) for x in flat.collect()} == {(a, b) for g, a, b in want if g == "y"}


MEMBERS = [(i, f"run{i % 5}", "how is the colour chosen", "a red shade" if i % 3 else "one blue tone", f" text {i} ") for i in range(60)]
MEMBERS += [(100 + i, f"run{5 + i}", "which colour is chosen", "a red shade of paint", None) for i in range(4)] + [(200, "run1", "rare", "once", "x")]


def members(spark):
    return spark.createDataFrame(MEMBERS, "did long, run string, fork string, option string, text string")


def test_traced_options(spark):
    rows = lineage.traced(members(spark)).collect()
    of = {}
    for r in rows:
        of.setdefault((r.fork, r.option), []).append(r)
    assert {k[1]: len(v) for k, v in of.items()} == {"a red shade": 14, "one blue tone": 14, "a red shade of paint": 4}
    assert all(sorted(x.id for x in v) == list(range(len(v))) for v in of.values())
    assert {r.n_members for r in of["how is the colour chosen", "a red shade"]} == {40} and all(r.text == r.text.strip() for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, lineage.traced(members(spark).repartition(3)).collect()))
    assert len({r.fork for r in lineage.traced(members(spark), forks=1).collect()}) == 1


def test_verdicts_that_break_the_rules(spark):
    shown = lineage.traced(members(spark))
    fork = "how is the colour chosen"
    given = lambda *v: {r.option: r.fault for r in lineage.checked_purity(shown, spark.createDataFrame([(fork, "a red shade", *v)], "fork string, option string, verdict string, rejects array<int>")).collect()}["a red shade"]
    assert given("coherent", []) is None and given("coherent", None) is None and given("impure", [13]) is None and given("split", []) is None
    assert given("coherent", [1]) == "coherent with rejects" and given("impure", []) == "impure without a reject"
    assert given("impure", [14]) == given("split", [-1]) == "reject not shown" and given("good", []) == given(None, []) == "no verdict"
    checked = lineage.checked_purity(shown, spark.createDataFrame([(fork, "a red shade", "impure", [1, 2])], "fork string, option string, verdict string, rejects array<int>"))
    r = lineage.purity(checked).first()
    assert (r.traced, r.raw_read, r.impure, r.rejected, r.rejected_share) == (1, 14, 1, 2, round(2 / 14, 6))
    assert checked.filter("fault = 'unanswered'").count() == 2
    assert lineage.purity(checked.limit(0)).first().traced == 0


def test_neighbours_and_residue(spark):
    (r,) = lineage.neighbours(members(spark)).collect()
    assert (r.a, r.b, r.together) == ("how is the colour chosen", "which colour is chosen", 0)
    assert r.score == pytest.approx(1.6 * 1.0 + jaccard({"red", "shade", "one", "blue", "tone"}, {"red", "shade", "paint"}))
    verdict = spark.createDataFrame([(r.a, r.b, True, "high"), ("x", "y", True, "low")], "a string, b string, same boolean, confidence string")
    assert tuple(lineage.identity(spark.createDataFrame([(r.a, r.b)], "a string, b string"), verdict).first()) == (1, 1, 1.0, 1)
    assert tuple(lineage.residue(members(spark)).first()) == (0, 1, 0.0)
    assert lineage.neighbours(members(spark).limit(0)).count() == 0 and tuple(lineage.residue(members(spark).limit(0)).first()) == (0, 0, 0.0)
