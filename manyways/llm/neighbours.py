"""Approximate nearest neighbours by collision counting over single random projections."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import discard, released, table, trimmed, written

BLOCK = 8192
QUERIES = 1024
PROJECTIONS = 250
WIDTH = 0.9
MISSED = 0.22
GROWTH = 1.2
START = 0.7
CELLS = 256
BAND = 512
SPREAD = 0.85
OWNERS = 100_000


class Band:
    """Sorted projections of vectors of like norms, and how windows around a query's value count them.

    Inner products become distances by one more component, sqrt(1 - |x|**2) after division by the band's largest norm; vectors of like
    norms keep it small. Each projection's sorted array is kept as each vector's place in it, in CELLS equal parts, and the values at the
    parts' borders; a window reaches to the borders around it, so it holds at least what it should.
    """

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, a: np.ndarray):
        self.x, self.rows = vectors[rows], rows
        squares = np.einsum("ij,ij->i", self.x, self.x)
        self.top = math.sqrt(squares.max())
        whole = np.column_stack((self.x / self.top, np.sqrt(np.maximum(1 - squares / self.top**2, 0))))
        p = a @ whole.T
        n = len(rows)
        order = np.argsort(p, axis=1, kind="stable")
        place = (np.arange(n) * min(CELLS, n) // n).astype(np.uint8)
        self.cell = np.empty(p.shape, np.uint8)
        np.put_along_axis(self.cell, order, np.broadcast_to(place, p.shape), axis=1)
        begins = np.flatnonzero(np.diff(place)) + 1
        self.borders = np.take_along_axis(p, order[:, begins], axis=1)  # the least value of each part but the first
        self.gap, self.inside = np.empty(p.shape, np.uint8), np.empty(p.shape, bool)

    def within(self, at: np.ndarray, half: float, need: int) -> np.ndarray:
        """Which vectors lie in `need` or more of the windows at +- half."""
        lo = (self.borders < (at - half)[:, None]).sum(axis=1).astype(np.uint8)
        hi = (self.borders <= (at + half)[:, None]).sum(axis=1).astype(np.uint8)
        np.subtract(self.cell, lo[:, None], out=self.gap)  # wraps round below the window
        np.less_equal(self.gap, (hi - lo)[:, None], out=self.inside)
        return np.flatnonzero(np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)


class Index:
    """Bands of a block's vectors, by falling norm.

    Windows centred on a query's values grow together (virtual rehashing) until the vectors that collide with it in enough of them are as
    many as asked for, then to WIDTH times the distance of the k-th nearest so far, which also begins the next band. A vector at
    distance d lies in a window of half width WIDTH * d with probability p = 2 * Phi(WIDTH) - 1, independently for each
    projection; the collision threshold is the MISSED quantile of that binomial, so of vectors as far as the k-th nearest about
    MISSED are lost and of nearer ones fewer, whatever the block's size and the vectors' norms. A band whose largest norm can't reach
    the k-th best score ends the search.
    """

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 7):
        self.n = len(vectors)
        self.a = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1] + 1))
        p = math.erf(WIDTH / math.sqrt(2))
        self.need = int(projections * p - _QUANTILE * math.sqrt(projections * p * (1 - p)))
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        order, self.bands, at = np.argsort(-norms, kind="stable"), [], 0
        falling = -norms[order]
        while at < self.n:
            to = max(int(np.searchsorted(falling, SPREAD * falling[at], "right")), at + BAND)
            to = self.n if self.n - to < BAND // 2 else to
            self.bands.append(Band(vectors, order[at:to], self.a))
            at = to
        self.verified = 0

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and inner products of the verified vectors that can be among a query's k nearest."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = (queries / norms[:, None]) @ self.a[:, :-1].T  # only a query's direction matters
        out, start = [], START
        for q in range(len(queries)):
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            for band in self.bands:
                least = np.partition(scores, len(scores) - k)[len(scores) - k] / norms[q] if len(scores) >= k else None
                if least is not None and least > band.top:
                    break
                half = start if least is None else self._reach(least, band)
                found = band.within(at[q], half, self.need)
                while len(found) < min(k - len(scores), len(band.rows)):
                    half *= GROWTH
                    found = band.within(at[q], half, self.need) if half < 64 else np.arange(len(band.rows))
                if least is None:
                    start = 0.9 * half
                s = band.x[found] @ queries[q]
                every = np.concatenate((scores, s))
                if least is None and len(every) >= k and len(found) < len(band.rows):
                    enough = self._reach(np.partition(every, len(every) - k)[len(every) - k] / norms[q], band)
                    if enough > half:
                        found = band.within(at[q], enough, self.need)
                        s = band.x[found] @ queries[q]
                self.verified += len(found)
                rows, scores = np.concatenate((rows, band.rows[found])), np.concatenate((scores, s))
            if len(rows) > k:
                best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]  # ties stay
                rows, scores = rows[best], scores[best]
            out.append((rows, scores))
        return out

    @staticmethod
    def _reach(least: float, band: Band) -> float:
        return WIDTH * math.sqrt(max(0.0, 2 - 2 * least / band.top)) + 1e-9


_QUANTILE = statistics.NormalDist().inv_cdf(1 - MISSED)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector in double precision: without null ids, and null, empty, zero, or partly null or non-finite vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(fine)


def alike(rows: DataFrame, keep: int) -> DataFrame:
    """vec and the `keep` smallest ids that have it: no other of them can be among a query's nearest. Each partition first keeps its own."""

    def first(batches):
        held: dict[bytes, set] = {}
        for batch in batches:
            column = batch.column(1)
            flat, off = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.array([len(x) for x in column], int))))
            for i, k in enumerate(batch.column(0).to_pylist()):
                ids = held.setdefault((flat[off[i] : off[i + 1]] + 0.0).tobytes(), set())
                ids.add(k)
                if len(ids) > 4 * keep:
                    held[(flat[off[i] : off[i + 1]] + 0.0).tobytes()] = set(sorted(ids)[:keep])
        keys = list(held)
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(k) for k in part], pa.list_(pa.float64())), pa.array([sorted(held[k])[:keep] for k in part], pa.list_(pa.int64()))], ["vec", "ids"])

    some = rows.select(F.col("vec_id").cast("long"), "vec").mapInArrow(trimmed(first), "vec array<double>, ids array<long>")
    return some.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, its k nearest by inner product among all other rows.

    Equal vectors are searched once, with their k + 1 smallest ids. Blocks of distinct vectors meet blocks of distinct queries, both of
    bounded size; each meeting returns one row a query, and these are merged in two steps. Ties go to smaller ids. Repeated
    rows (same id and vector) count once; an id with several vectors is a candidate with each of them, and as a query has a ranking for each,
    all under that id; unusable vectors take no part; other columns play no part; vectors of another length than the query's aren't
    compared; an empty table gives an empty result.
    """
    rows = usable(vectors)
    groups = written(alike(rows, k + 1).withColumn("dim", F.size("vec")), "groups")
    asked = written(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).distinct().withColumn("key", F.sha2(F.to_json("vec"), 256)), "asked")
    distinct = written(asked.groupBy("key").agg(F.first("vec").alias("vec")), "distinct-queries")
    nb, nq = max(1, math.ceil(groups.count() / block)), max(1, math.ceil(distinct.count() / QUERIES))
    data = groups.withColumn("b", F.pmod(F.xxhash64("vec"), F.lit(nb)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    queries = distinct.withColumn("dim", F.size("vec")).withColumn("q", F.pmod(F.xxhash64("key"), F.lit(nq)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            with released():
                left = left.assign(first=[x[0] for x in left["ids"]]).sort_values("first")
                x, asked = np.stack(list(left["vec"])), np.stack(list(right["vec"]))
                size = max(np.abs(x).max(), np.finfo(float).tiny)  # of the scaled vectors no square overflows
                ids, first = list(left["ids"]), left["first"].to_numpy()
                for key, q, (found, _) in zip(right["key"], asked, Index(x / size).search(asked / np.abs(asked).max(axis=1, keepdims=True), k + 1), strict=True):
                    scores = x[found] @ q
                    order = np.lexsort((first[found], -scores))[: k + 1]
                    hits = sorted((-float(scores[o]), int(i)) for o in order for i in ids[found[o]])[: k + 1]
                    out.append((key, int(right["b"].iloc[0]), [{"minus": s, "vec_id": i} for s, i in hits]))
        return pd.DataFrame(out, columns=["key", "b", "hits"])

    met = data.groupBy("dim", "b", "q").cogroup(queries.groupBy("dim", "b", "q")).applyInPandas(meet, "key string, b int, hits array<struct<minus: double, vec_id: long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1).alias("hits")
    lists = met.groupBy("key", F.pmod("b", F.lit(math.isqrt(nb) + 1)).alias("part")).agg(best).groupBy("key").agg(best)
    # equal queries come together in lists of OWNERS ids at most, about, so that a vector that many have is no hot key
    salts = math.ceil(asked.count() / OWNERS) or 1
    owners = asked.groupBy("key", F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt")).agg(F.collect_list("query_id").alias("owners"))
    lists = written(lists, "lists")
    discard(groups, distinct)
    own = owners.join(lists, "key").select(F.explode("owners").alias("query_id"), "hits")
    each = own.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit")["vec_id"].alias("vec_id"), (-F.col("hit")["minus"]).alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
