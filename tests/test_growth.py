"""Steps whose work must not grow faster than their tables, against the plain form of the same results."""

import random

import pytest
from pyspark.sql import functions as F

from manyways.operators import ablation, agreement, checks, cluster, surrogate

R = random.Random(11)


def test_headers_pass_decisions_once(spark):
    rows = [(t, f"c{run % 2}", run, did) for did, run, t in ((R.randrange(50), R.randrange(6), f"t{R.randrange(70)}") for _ in range(600))]
    d = spark.createDataFrame([*rows, (None, "c9", 1, 2), ("t0", "c0", None, None)], "tag string, corpus string, run int, did long")
    out = ablation.headers(d)
    assert "Expand" not in out._jdf.queryExecution().toString()  # a row for each distinct count
    got = {r.tag: (r.corpora, r.runs, r.decisions) for r in out.collect()}
    for tag in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tag] + ([("t0", "c0", None, None)] if tag == "t0" else [])
        assert got[tag] == ("+".join(sorted({r[1] for r in own})), len({r[2] for r in own} - {None}), len({r[3] for r in own} - {None}))
    assert got[None] == ("c9", 1, 1) and len(got) == len({r[0] for r in rows}) + 1
    assert ablation.headers(d.limit(0)).count() == 0


def test_batches_read_their_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tokens = spark.createDataFrame([(f"o{i}", f"w{i % 3}") for i in range(12)], "option string, token string").mapInArrow(count, "option string, token string")
    options = spark.createDataFrame([(f"o{i}", i) for i in range(12)], "option string, runs int")
    assert cluster.nearest_batches(options, tokens, 4).count() == 12 and seen.value == 12


def test_far_terms_of_expected_information_change_nothing(spark, monkeypatch):
    items = spark.range(40_000).select((F.xxhash64("id") % 3).alias("a"), (F.xxhash64("id", F.lit(1)) % 4).alias("b"))
    near = agreement.adjusted_mutual_information(items)
    one = near.first()
    monkeypatch.setattr(agreement, "TAIL", 1e9)
    assert agreement.adjusted_mutual_information(items).first() == one and abs(one.ami) < 0.01


def test_levels_counted_without_absent_rows(spark):
    rows = [(i, f"r{R.randrange(60)}", i, f"f{min(int(R.expovariate(0.6)), 6)}", f"o{min(int(R.expovariate(0.9)), 5)}") for i in range(500)]
    choice = spark.createDataFrame([*rows, (900, None, 1, "f0", "o0")], "did long, run string, line long, fork string, option string")
    level, counts = surrogate.reached(choice, 5)
    plain = {(r.fork, r.level): r.runs for r in surrogate.level_table(surrogate.players(choice, 5)).collect()}
    assert {(r.fork, r.level): r.runs for r in counts.collect()} == plain and len(plain) > 8
    assert level.filter("level = 'absent'").count() == 0
    assert {sum(n for (f, _), n in plain.items() if f == fork) for fork, _ in plain} == {choice.select("run").distinct().count()}


def test_drawn_recipes_have_the_shares_of_options(spark):
    rows = [(i * 2 + j, i, j, f"f{j}", "x" if (i + j * (i % 3)) % 4 else "y") for i in range(400) for j in range(2)]
    choice = spark.createDataFrame(rows, "did long, run int, line int, fork string, option string")
    out = checks.recipes_null(choice, 300)
    assert "sequence(" not in out._jdf.queryExecution().toString()  # no row for each draw, run and fork
    r = out.first()
    assert (r.paths, r.null_min, r.null_max) == (len({tuple(sorted((f, o) for _, q, _, f, o in rows if q == i)) for i in range(400)}), 4.0, 4.0)
    rare = spark.createDataFrame([(i * 2 + j, i, j, f"f{j}", "y" if i < 2 else "x") for i in range(40) for j in range(2)], "did long, run int, line int, fork string, option string")
    r = checks.recipes_null(rare, 2000).first()  # of xx, xy, yx, yy with shares of .9025, .0475, .0475 and .0025 over 40 runs
    want = sum(1 - (1 - p) ** 40 for p in (0.9025, 0.0475, 0.0475, 0.0025))
    assert r.paths == 2 and abs(r.null_mean - want) < 0.06


def test_labels_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, "r1", "f", "red wine"), (2, "r1", "f", "red wines"), (3, "r2", "f", "white"), (4, "r2", "g", "white"), (5, "r1", "f", "white"), (6, None, "f", "red wine"), (7, None, "f", "blue")]
    choice = spark.createDataFrame(rows, "did long, run string, fork string, option string")
    labels = choice.select("fork", F.col("option").alias("label")).mapInArrow(count, "fork string, label string")
    assert [(r.fork, r.a, r.b) for r in checks.alike(labels, 0.5, "fork").collect()] == [("f", "red wine", "red wines")] and seen.value == len(rows)
    out = checks.same_slot(choice)
    assert "Expand" not in out._jdf.queryExecution().toString() and [tuple(r) for r in out.collect()] == [("f", 3, 1)]
