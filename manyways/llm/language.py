"""Language identification: a bidirectional gated recurrent network over bytes labels every position; documents pool them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import buffers, crc_mod, table, trimmed

HIDDEN = 12
WINDOW = 96
TRAIN_WINDOW = 48
PER_LANGUAGE = 500
STEPS = 300
BATCH = 128
#: Windows that each language is trained on at least, however many languages there are.
PER_NAME = 2000
RATE = 0.01
TOGETHER = 1024
WINDOWS = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """w: input rows of each byte (256 x 3H) and u: recurrent weights (H x 3H) of both directions, v: output (2H x L), c: output bias.
    The thirds of 3H are the update gate, the reset gate and the candidate."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray
    names: list[str]

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.v, self.c]

    def run(self, x: np.ndarray, d: int, keep: list | None = None, lengths: np.ndarray | None = None) -> np.ndarray:
        """States (T x N x H) of direction d over x (T x N bytes). lengths: of each column, longest first; a state stays as it is beyond its
        column's end, so that the backward direction begins at each column's own last byte."""
        w, u, n = self.w[d], self.u[d], self.u[d].shape[0]
        out = np.empty((*x.shape, n), np.float32)
        h = np.zeros((x.shape[1], n), np.float32)
        live = np.full(len(x), x.shape[1]) if lengths is None else np.searchsorted(-lengths, -np.arange(len(x)))
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            m = live[t]
            before = h[:m]
            a = w[x[t, :m]]
            b = before @ u
            gates = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, new, b[:, 2 * n :]))
            now = new + z * (before - new)
            h = now if m == len(h) else np.concatenate((now, h[m:]))
            out[t] = h
        return out

    def positions(self, x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (T x N x L) of every position; those beyond a column's length mean nothing."""
        p = np.concatenate((self.run(x, 0, None, lengths), self.run(x, 1, None, lengths)), axis=2) @ self.v + self.c
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy of all positions of x (T x N) with labels y (N), and its gradients by back-propagation through time."""
        steps, count = x.shape
        n = self.u[0].shape[0]
        kept: list[list] = [[], []]
        states = np.concatenate([self.run(x, d, kept[d]) for d in (0, 1)], axis=2)
        p = states @ self.v + self.c
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(count), y] + 1e-9).mean())
        p[:, np.arange(count), y] -= 1
        p /= steps * count
        dv, dc = np.tensordot(states, p, ((0, 1), (0, 1))), p.sum(axis=(0, 1))
        ds = p @ self.v.T
        dw, du = [np.zeros_like(w) for w in self.w], [np.zeros_like(u) for u in self.u]
        for d in (0, 1):
            u = self.u[d]
            dh = np.zeros((count, n), np.float32)
            for t, h, z, r, new, b in reversed(kept[d]):
                dh = dh + ds[t, :, d * n : (d + 1) * n]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * b * r * (1 - r)
                da = np.concatenate((dz, dr, dnew), axis=1)
                db = np.concatenate((dz, dr, dnew * r), axis=1)
                du[d] += h.T @ db
                np.add.at(dw[d], x[t], da)
                dh = dh * z + db @ u.T
        return loss, [*dw, *du, dv, dc]


def fresh(names: list[str], hidden: int = HIDDEN, seed: int = 5) -> Model:
    r = np.random.default_rng(seed)
    normal = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
    return Model([normal(256, 3 * hidden, k=0.3) for _ in (0, 1)], [normal(hidden, 3 * hidden, k=hidden**-0.5) for _ in (0, 1)], normal(2 * hidden, len(names), k=0.3), np.zeros(len(names), np.float32), names)


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> Model | None:
    """Adam over windows at random places; the languages take turns, so each has equally many. None without texts."""
    names = sorted({*labels})
    by = [[t for t, y in zip(texts, labels, strict=True) if y == n and t] for n in names]
    names, by = [n for n, b in zip(names, by, strict=True) if b], [b for b in by if b]
    if not names:
        return None
    model, r = fresh(names), np.random.default_rng(seed)
    p = model.parameters()
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    steps = max(steps, math.ceil(len(names) * PER_NAME / BATCH))
    for step in range(1, steps + 1):
        y = ((step - 1) * BATCH + np.arange(BATCH)) % len(names)
        x = np.zeros((TRAIN_WINDOW, BATCH), np.uint8)
        for i, k in enumerate(y):
            t = by[k][r.integers(len(by[k]))]
            while len(t) < TRAIN_WINDOW:
                t = t + b" " + t
            at = r.integers(len(t) - TRAIN_WINDOW + 1)
            x[:, i] = np.frombuffer(t, np.uint8, TRAIN_WINDOW, at)
        _, g = model.gradients(x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = math.sqrt(sum(float((a * a).sum()) for a in g))
        for a, b, c, d in zip(p, g, m, s, strict=True):
            b = b * min(1.0, 1.0 / (norm + 1e-9))
            c += 0.1 * (b - c)
            d += 0.01 * (b * b - d)
            a -= rate * (c / (1 - 0.9**step)) / (np.sqrt(d / (1 - 0.99**step)) + 1e-6)
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Of about per_language learnable texts of each language, chosen by hash of doc_id: WINDOWS windows each, at places anywhere in the
    whole text, also by hash. What a language sends to the driver is bounded; there are as many as the data have. Where one doc_id comes
    many times its rows are chosen together: then rows of the highest ids go beyond twice the bound."""
    fine = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (crc_mod(F.col("doc_id"), 5) != 0))
    n = {r["lang"]: r["n"] for r in fine.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], []
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, per_language / v))])[F.col("lang")]
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    room = F.greatest(F.length("text") - TRAIN_WINDOW + 1, F.lit(1))
    windows = F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), lambda i: F.substring("text", (F.pmod(F.xxhash64("doc_id", i), room) + 1).cast("int"), F.lit(TRAIN_WINDOW)))
    rows = fine.filter(h < share * float(1 << 30)).select("doc_id", "lang", windows.alias("t")).orderBy("doc_id", "t").limit(2 * per_language * len(n)).collect()
    return [t.encode() for r in rows for t in r["t"]], [r["lang"] for r in rows for _ in r["t"]]


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's mean of its positions' probabilities. Texts are cut into windows of WINDOW bytes, run side by side; none sees another."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), per)
    first = np.cumsum(per) - per
    start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    length = np.minimum(WINDOW, offsets[1:][owner] - start)
    total = np.zeros((len(sizes), len(model.names)))
    by = np.argsort(-length, kind="stable")
    for k in range(0, len(by), TOGETHER):
        w = by[k : k + TOGETHER]
        longest = int(length[w[0]])
        t = np.arange(longest)[:, None]
        inside = t < length[w][None, :]
        x = data[np.minimum(start[w][None, :] + t, len(data) - 1)]
        sums = np.einsum("tnl,tn->nl", model.positions(x, length[w]), inside.astype(np.float32))
        np.add.at(total, owner[w], sums)
    return total / np.maximum(sizes, 1)[:, None]


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Null texts, and those without a letter, are `und` with score 0, as is every
    text if nothing could be learned. A prediction depends on the text alone, up to the last digits of single-precision products (1e-6);
    other columns play no part. Texts of any length are labelled whole; equal rows give equal rows; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for batch in batches:
            m = sent.value
            data, off, _ = buffers(batch.column(2))
            n = batch.num_rows
            names, scores = np.full(n, "und", object), np.zeros(n)
            if m is not None and n:
                at = 0
                while at < n:
                    to = max(at + 1, int(np.searchsorted(off, off[at] + 1_000_000, "right")) - 1)
                    p = pooled(m, data[off[at] : off[to]], off[at : to + 1] - off[at]) if off[to] > off[at] else np.zeros((to - at, len(m.names)))
                    best = p.argmax(axis=1)
                    names[at:to] = np.array(m.names, object)[best]
                    scores[at:to] = np.clip(p[np.arange(to - at), best], 0, 1)
                    at = to
                for i, t in enumerate(batch.column(2)):
                    if not any(map(str.isalpha, t.as_py())):
                        names[i], scores[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(trimmed(each), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, train(*sample(docs)))
