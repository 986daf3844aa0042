"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import buffers, crc_mod, table, trimmed, written

BUCKETS = 4096
SHAPES = 64
LABELLED = 4096
RANK = 64
NEIGHBOURS = 15
POWER = 6
SHAPE_WEIGHT = 0.5
BLOCK = 256
CHUNK = 1_000_000

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True


def counts(data: np.ndarray, offsets: np.ndarray):
    """For each text (bytes between offsets): counts of hashed 3-byte terms, and of SHAPES pseudo-terms on its make-up.

    The pseudo-terms are soft steps of: shares of distinct and of repeated words, of capitals, of marks, of digits, of line ends
    and of white space, and the length, 8 steps each.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        b = data[offsets[at] : offsets[to]]
        x = b.astype(np.uint32)
        h = np.zeros(len(b), np.uint32)
        if len(b) > 2:
            h[:-2] = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)
        for i in range(at, to):
            a, z = offsets[i] - offsets[at], offsets[i + 1] - offsets[at]
            tf = np.bincount(h[a : z - 2], minlength=BUCKETS) if z - a > 2 else np.zeros(BUCKETS, np.int64)
            yield tf, shape(b[a:z])
        at = to


def shape(b: np.ndarray) -> np.ndarray:
    out = np.zeros((SHAPES // 8, 8), np.float32)
    if len(b):
        words = b.tobytes().split()
        distinct = len({*words})
        n = len(words) or 1
        pairs = len({*zip(words, words[1:], strict=False)}) / max(1, n - 1)
        marks = ~(_alnum[b] | _space[b])
        shares = (distinct / n, pairs, _upper[b].mean() * 4, marks.mean() * 4, _digit[b].mean() * 4, (b == 10).mean() * 20, _space[b].mean() * 3, np.log1p(len(b)) / 12)
        for row, s in zip(out, shares, strict=True):
            place = min(max(float(s), 0.0), 1.0) * 7
            low = int(place)
            row[low] += 1 - (place - low)
            if low < 7:
                row[low + 1] += place - low
    return out.ravel()


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms and pseudo-terms x RANK
    vectors: np.ndarray  # labelled, unit length
    labels: np.ndarray
    prior: float

    def terms(self, tf: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        x = np.log1p(tf).astype(np.float32) * self.idf
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        return np.hstack((x, SHAPE_WEIGHT * shapes / np.sqrt(SHAPES / 8)))

    def project(self, tf: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        v = self.terms(tf, shapes) @ self.basis
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, tf: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Cosines of a block of texts with every labelled vector; the NEIGHBOURS nearest vote with weights cosine ** POWER."""
        cosines = self.project(tf, shapes) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** POWER
        total = w.sum(axis=1)
        some = (w * self.labels[near]).sum(axis=1)
        return np.where(total > 0, np.clip(some / np.where(total > 0, total, 1), 0, 1), self.prior)


def fit(tf: np.ndarray, shapes: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """TF-IDF weights and a truncated SVD (randomised, with power steps) of the labelled sample."""
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(idf, np.zeros((BUCKETS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), float(labels.mean()))
    x = np.empty((len(tf), BUCKETS + SHAPES), np.float32)
    for a in range(0, len(tf), BLOCK):  # no copies of the whole
        x[a : a + BLOCK] = model.terms(tf[a : a + BLOCK], shapes[a : a + BLOCK])
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(3).standard_normal((len(x), min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    model.basis = (q @ vt[:rank].T).astype(np.float32)
    v = x @ model.basis
    model.vectors = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    return model


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and labels of at most `most` labelled texts whose labels may be learned, those of the least hashes of doc_id."""
    fine = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(crc_mod(F.col("doc_id"), 4) != 2)
    chosen = written(fine.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")

    def each(batches):
        for batch in batches:
            data, off, _ = buffers(batch.column(0))
            terms, many, shapes = [], [], []
            with np.errstate(over="ignore"):
                for tf, s in counts(data, off):
                    at = np.flatnonzero(tf)
                    terms.append(at.astype(np.int32))
                    many.append(tf[at].astype(np.int32))
                    shapes.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float32())), batch.column(1), batch.column(2)], ["terms", "many", "shapes", "quality", "doc_id"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality", F.col("doc_id").cast("long"))
    rows = texts.mapInArrow(trimmed(each), "terms array<int>, many array<int>, shapes array<float>, quality int, doc_id long").orderBy("doc_id").limit(2 * most).toArrow()
    tf = np.zeros((rows.num_rows, BUCKETS), np.float32)
    for i, (t, m) in enumerate(zip(rows["terms"], rows["many"], strict=True)):
        tf[i, t.values.to_numpy()] = m.values.to_numpy()
    shapes = np.array(rows["shapes"].to_pylist(), np.float32).reshape(-1, SHAPES)
    return tf, shapes, rows["quality"].to_numpy().astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model | None:
    """None if no label can be learned."""
    tf, shapes, y = labelled(docs, labels, most)
    return fit(tf, shapes, y) if len(y) else None


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs and a score (0 to 1) under a name that docs doesn't have yet, which depends on the text alone. Null and empty texts score as the share of label 1 among the
    learned labels, as any text does if nothing could be learned (0.5). Repeated rows give repeated rows. The model (at most
    LABELLED vectors) is broadcast."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            m = sent.value
            data, off, _ = buffers(batch.column(batch.num_columns - 1))
            out = np.full(batch.num_rows, 0.5)
            if m is not None:
                at, tfs, shapes = 0, [], []
                with np.errstate(over="ignore"):
                    for tf, s in counts(data, off):
                        tfs.append(tf)
                        shapes.append(s)
                        if len(tfs) == BLOCK:
                            out[at : at + BLOCK] = m.score(np.array(tfs), np.array(shapes))
                            at, tfs, shapes = at + BLOCK, [], []
                if tfs:
                    out[at:] = m.score(np.array(tfs), np.array(shapes))
                out[off[1:] == off[:-1]] = m.prior
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + f"`{name}` double"
    return docs.select("*", F.coalesce("text", F.lit(""))).mapInArrow(trimmed(each), schema)


def quality(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, table(spark, sf_dir, "labels")))
