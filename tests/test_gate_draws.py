"""Gates under random reach, against loops over the same permutations."""

import collections
import random

import numpy as np
import pytest

from manyways.operators import checks, forks, resample


def test_places_are_renamed_one_to_one():
    for n in (1, 2, 5, 64, 1000):
        for group in (0, 3):
            to = resample.renamed(np.arange(n), np.full(n, group), 2, n)
            assert sorted(to.tolist()) == list(range(n))
    a, b, c = (resample.renamed(np.arange(1000), np.full(1000, g), d, 1000) for g, d in ((0, 0), (0, 1), (1, 0)))
    assert (a == b).mean() < 0.02 and (a == c).mean() < 0.02


@pytest.mark.parametrize("size", [7, 32_768])
def test_gate_draws_by_loop(spark, monkeypatch, size):
    monkeypatch.setattr(checks, "SLICE", size)
    monkeypatch.setattr(checks, "MEETINGS", 100)
    r = random.Random(4)
    rows = [(run, f"f{k}", f"o{int(r.random() < 0.1)}", r.randrange(1, 9) + 3 * k) for run in range(90) for k in range(11) if r.random() < (0.8 if k < 3 else 0.3) for _ in range(r.choice((1, 1, 1, 1, 2)))]
    rows += [(None, "f1", "o1", 1), (3, "f2", None, 2), (4, "rare", "o0", 3)]
    choice = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "did long, run int, fork string, option string, line long").filter("fork is not null")
    place = {p.fork: p.position for p in forks.positions(choice).collect() if p.runs >= 8}
    of, by, whole = collections.defaultdict(set), collections.defaultdict(set), sorted({x[0] for x in rows if x[0] is not None})
    for run, fork, option, _ in rows:
        if run is not None:
            of[fork].add(run)
            if option:
                by[fork, option].add(run)
    number, want = {f: i for i, f in enumerate(sorted(place))}, []
    for draw in range(4):
        drawn = {}
        for f, i in number.items():
            at = np.array([whole.index(x) for x in sorted(of[f])])
            drawn[f] = {whole[j] for j in resample.renamed(at, np.full(len(at), i), draw, len(whole))}
        n = 0
        for (f, _), own in by.items():
            if f in place and len(own) >= 5 and len(of[f]) - len(own) >= 5:
                for b in place:
                    hit, hits = len(own & drawn[b]), len(of[f] & drawn[b])
                    n += b != f and place[b] > place[f] and hit >= 5 and hit / len(own) >= 0.25 and (hits - hit) / (len(of[f]) - len(own)) <= 0.06
        want.append((draw, n))
    assert sorted(map(tuple, checks.gate_null(choice, 4).collect())) == want and any(n for _, n in want)


def test_counts_are_as_many_as_tasks(spark, monkeypatch):
    """Runs in many slices give no more counts than those in few, and the same gates."""
    rows = [(i, i % 97, i, f"f{i % 5}", f"o{(i * 7) % 3}") for i in range(1200)]
    choice, made, found = spark.createDataFrame(rows, "did long, run long, line long, fork string, option string").cache(), [], []
    kept = checks.stored
    monkeypatch.setattr(checks, "stored", lambda df, **k: (made.append(k), kept(df, **k))[1])
    for size in (1000, 3):
        monkeypatch.setattr(checks, "SLICE", size)
        found.append(sorted(map(tuple, checks.gate_null(choice, 2).collect())))
    assert found[0] == found[1] and made.count({"freed": True}) == 4  # a draw's shuffle files go before the next
