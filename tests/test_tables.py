"""Tables with fixed margins against shuffled rows and closed forms."""

import math
import random

import numpy as np
import pytest

from manyways.operators import tables


def test_random_tables_like_shuffled_labels():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    rows, columns = np.bincount(x), np.bincount(y)
    drawn = tables.random_tables(rows, columns, 4000, rng)
    assert (drawn.sum(axis=2) == rows).all() and (drawn.sum(axis=1) == columns).all() and (drawn >= 0).all()
    assert drawn.mean(axis=0) == pytest.approx(np.outer(rows, columns) / 40, abs=0.1)
    shuffled = np.zeros((4000, 3, 4), int)
    for t in shuffled:
        np.add.at(t, (x, rng.permutation(y)), 1)
    assert drawn.var(axis=0) == pytest.approx(shuffled.var(axis=0), abs=0.15)
    v, w = tables.cramers_v(drawn), tables.cramers_v(shuffled)
    assert np.quantile(v, [0.1, 0.5, 0.9, 0.99]) == pytest.approx(np.quantile(w, [0.1, 0.5, 0.9, 0.99]), abs=0.015)


def test_deepening_and_exact_p():
    seen, done, _, p = tables.v_test(np.array([[12, 0], [0, 12]]), 1)
    assert (seen, done) == (1.0, 40_600) and p == pytest.approx(2 / math.comb(24, 12), abs=5e-5)
    table = np.array([[5, 2], [2, 5]])
    exact = sum(math.comb(7, k) * math.comb(7, 7 - k) for k in (0, 1, 2, 5, 6, 7)) / math.comb(14, 7)
    _, done, _, p = tables.v_test(table, 2, screen=20_000)
    assert done == 20_000 and p == pytest.approx(exact, abs=0.01)
    assert tables.v_test(np.array([[3], [4]]), 1)[3] == 1.0


def test_co_choice(spark):
    r = random.Random(6)
    rows = []
    for run in range(150):
        x = r.choice("pqr")
        for line, (fork, option) in enumerate((("f", x), ("g", x if r.random() < 0.7 else r.choice("pqr")), ("h", r.choice("st")), ("one", "only"))):
            rows.append((run * 10 + line, run, "arm", line, fork, option))
    choice = spark.createDataFrame(rows, "did long, run long, arm string, line int, fork string, option string")
    got = {(x.a, x.b): x for x in tables.co_choice(choice).collect()}
    assert set(got) == {("f", "g"), ("f", "h"), ("g", "h")}
    x = got["f", "g"]
    assert x.deep and x.perms == 40_600 and x.significant and x.p < 1e-3 and x.v > x.null_v and x.n == 150
    assert got == {(x.a, x.b): x for x in tables.co_choice(choice.repartition(3)).collect()}
    assert tables.co_choice(choice.limit(0)).count() == 0


def test_arm_edges_in_closed_form(spark):
    edges = [("u", "v", run, "north" if run < 8 else "south") for run in range(9)] + [("v", "w", run, "north" if run < 8 else "south") for run in range(6, 20)]
    got = {(x.a, x.b, x.arm): x for x in tables.arm_edges(spark.createDataFrame([*edges, edges[0]], "a string, b string, run long, arm string")).collect()}
    exact = lambda n, walkers, arm: sum(math.comb(arm, k) * math.comb(20 - arm, walkers - k) for k in range(n, min(arm, walkers) + 1)) / math.comb(20, walkers)
    for key, n, walkers, arm in ((("u", "v", "north"), 8, 9, 8), (("u", "v", "south"), 1, 9, 12), (("v", "w", "north"), 2, 14, 8), (("v", "w", "south"), 12, 14, 12)):
        assert (got[key].n, got[key].walkers) == (n, walkers) and got[key].p == pytest.approx(exact(n, walkers, arm), abs=1e-9)
    assert got["u", "v", "north"].significant and not got["u", "v", "south"].significant
