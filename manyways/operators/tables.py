"""Tests on contingency tables with fixed margins: shuffling one label among rows only redraws the table, so tables are drawn, not rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyways.functions.stats import benjamini_hochberg, fisher_tail
from manyways.operators import forks
from manyways.operators.cluster import stored
from manyways.operators.resample import SEED

SCREEN, DEEP, BELOW = 600, 40_000, 0.05
FDR = 0.05
#: So many tables are drawn at once.
TOGETHER = 2000


def random_tables(rows: np.ndarray, columns: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n tables (n x rows x columns) with these margins, as a random order of one label gives them: each row takes its members from what
    the rows before it left of every column."""
    left = np.repeat(columns[None, :].astype(np.int64), n, axis=0)
    out = np.zeros((n, len(rows), len(columns)), np.int64)
    for i, size in enumerate(rows):
        wanted, pool = np.full(n, size, np.int64), left.sum(axis=1)
        for j in range(len(columns)):
            pool = pool - left[:, j]
            out[:, i, j] = rng.hypergeometric(left[:, j], pool, wanted)
            wanted = wanted - out[:, i, j]
        left -= out[:, i]
    return out


def cramers_v(tables: np.ndarray) -> np.ndarray:
    """Cramér's V of tables (... x rows x columns) without empty rows or columns; 0 with one of either."""
    r, c = tables.sum(axis=-1, keepdims=True), tables.sum(axis=-2, keepdims=True)
    k = min(tables.shape[-2:]) - 1
    if k < 1:
        return np.zeros(tables.shape[:-2])
    return np.sqrt(np.maximum((tables * tables / (r * c)).sum(axis=(-2, -1)) - 1, 0) / k)


def v_test(table: np.ndarray, seed: int, screen: int = SCREEN, deep: int = DEEP, below: float = BELOW) -> tuple[float, int, float, float]:
    """V, draws, the null's mean V and p = (draws at or above + 1) / (draws + 1): `screen` tables, and `deep` more where p is below `below`.
    p can't go below 1 / (draws + 1), so a screen alone can never pass a threshold over many tests."""
    seen, rng = float(cramers_v(table)), np.random.default_rng(seed)
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    done, reached, total = 0, 0, 0.0
    for more in (screen, deep):
        for at in range(0, more, TOGETHER):
            v = cramers_v(random_tables(rows, columns, min(TOGETHER, more - at), rng))
            done, reached, total = done + len(v), reached + int((v >= seen - 1e-12).sum()), total + float(v.sum())
        if (reached + 1) / (done + 1) >= below:
            break
    return seen, done, total / max(done, 1), (reached + 1) / (done + 1)


def flagged(tests: DataFrame, q: float = FDR) -> DataFrame:
    """tests (p) with significant: whether p lies within the false-discovery threshold over all of them."""
    kept = stored(tests)
    limit = benjamini_hochberg(kept, "p", q).select("threshold")  # one row
    return kept.crossJoin(F.broadcast(limit)).withColumn("significant", (F.col("p") <= F.col("threshold")) & (F.col("threshold") > 0)).drop("threshold")


def co_choice(choice: DataFrame, least: int = 20, reach: int = 100, screen: int = SCREEN, deep: int = DEEP, seed: int = SEED) -> DataFrame:
    """a, b, n, v, perms, deep, null_v, p, significant: whether the option at one fork goes with that at the other, over the runs that face both
    (`least` or more; forks that `reach` runs or more face, with two options or more each). Seeds come from the forks' names. A task holds
    one pair's table of options, never its runs."""
    m = forks.modal(choice)
    m = m.join(m.groupBy("fork").agg(F.count("*").alias("n")).filter(F.col("n") >= reach).select("fork"), "fork")
    both = m.select("run", F.col("fork").alias("a"), F.col("option").alias("x")).join(m.select("run", F.col("fork").alias("b"), F.col("option").alias("y")), "run").filter("a < b")
    cells = both.groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    pairs = cells.groupBy("a", "b").agg(F.sum("o").alias("n"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"), F.array_sort(F.collect_list(F.struct("x", "y", "o"))).alias("cells"))
    fine = pairs.filter((F.col("n") >= least) & (F.least("kx", "ky") > 1))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, n, own in zip(pdf["a"], pdf["b"], pdf["n"], pdf["cells"], strict=True):
                x, y = (np.unique([c[k] for c in own], return_inverse=True)[1] for k in ("x", "y"))
                table = np.zeros((x.max() + 1, y.max() + 1), np.int64)
                table[x, y] = [c["o"] for c in own]
                v, done, null, p = v_test(table, zlib.crc32(f"{seed}|{a}|{b}".encode()), screen, deep)
                out.append((a, b, int(n), v, done, done > screen, null, p))
            yield pd.DataFrame(out, columns=["a", "b", "n", "v", "perms", "deep", "null_v", "p"])

    dealt = fine.select("a", "b", "n", "cells").repartition("a", "b")  # pairs take long: each core some
    return flagged(dealt.mapInPandas(each, "a string, b string, n long, v double, perms long, deep boolean, null_v double, p double"))


def arm_edges(edges: DataFrame, q: float = FDR) -> DataFrame:
    """edges (a, b, run, arm): per edge and arm n, runs, p and significant. p is the exact chance that as many of an edge's walkers belong to
    the arm when arms are shuffled over runs (hypergeometric), which any number of shuffles only approaches."""
    runs = edges.select("run", "arm").distinct()
    arms = runs.groupBy("arm").agg(F.count("*").alias("of_arm"))
    walkers = edges.select("a", "b", "run").distinct().groupBy("a", "b").agg(F.count("*").alias("walkers"))
    n = edges.select("a", "b", "arm", "run").distinct().groupBy("a", "b", "arm").agg(F.count("*").alias("n"))
    total = runs.agg(F.count("*").alias("runs"))  # one row
    t = n.join(arms, "arm").join(walkers, ["a", "b"]).crossJoin(F.broadcast(total))
    p = fisher_tail(t, "n", "walkers", "of_arm", "runs").withColumn("p", F.round("p", 12))
    return flagged(p.select("a", "b", "arm", "n", "walkers", "p"), q)
