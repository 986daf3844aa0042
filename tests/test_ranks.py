"""Ranks, quantiles, bins and thresholds over ranges of rows, against sorted lists."""

import random

import pytest

from manyways.functions import stats

R = random.Random(2)
#: A third of all values are equal; some are null.
ROWS = [(i, R.choice(["a", "b", None]), 7.0 if R.random() < 0.33 else R.choice([None, R.randrange(20) / 2, R.gauss(5, 3)])) for i in range(500)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, g string, v double").repartition(5)


def key(v):
    return (v is not None, v or 0.0)


def plain(rows):
    vs = [key(v) for _, _, v in rows]
    return {i: sum(x < key(v) for x in vs) + (sum(x == key(v) for x in vs) + 1) / 2 for i, _, v in rows}


def test_average_ranks(df):
    assert {r.id: r.r for r in stats.average_ranks(df, "v", "r").collect()} == plain(ROWS)
    want = {i: x for g in ("a", "b", None) for i, x in plain([r for r in ROWS if r[1] == g]).items()}
    assert {r.id: r.r for r in stats.average_ranks(df, "v", "r", "g").collect()} == want
    assert stats.average_ranks(df.limit(0), "v", "r", "g").count() == 0


def test_quantiles_and_bins(df):
    vs = sorted(v for _, _, v in ROWS if v is not None)
    for q in (0.0, 0.25, 0.5, 0.9):
        assert stats.upper_quantile(df, "v", q).first().cut == vs[int(len(vs) * q)]
    assert stats.upper_quantile(df.limit(0), "v").first().cut is None
    order = [i for i, _, v in sorted(ROWS, key=lambda r: (key(r[2]), r[0]))]
    assert {r.id: r.bin for r in stats.bins(df, "v", "id", 7).collect()} == {i: min(at // (500 // 7), 6) for at, i in enumerate(order)}


def test_threshold_of_false_discoveries(spark):
    for seed in range(6):
        r = random.Random(seed)
        ps = [round(r.random() ** 3, 2) for _ in range(80)]
        passing = [p for rank, p in enumerate(sorted(ps), 1) if p <= 0.05 * rank / len(ps)]
        got = stats.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double"), "p").first()
        assert (got.tests, got.threshold) == (80, max(passing, default=0.0))
    assert stats.benjamini_hochberg(spark.createDataFrame([], "p double"), "p").first().tests == 0
