"""Best-fit packing: lengths of token pieces into sequences, gaps filled by exact complements first."""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyways.llm.common import mixed, parts, powers, prefix_hash, table, trimmed, written

LIMIT = 2048
CHARS = 1_000_000
KNOWN = 300_000
SENTINEL = chr(0x10FFFF)
CONTRACTION = r"'(?:[stmd]|re|ve|ll)"


class Words:
    """Token ids of texts by a word-level tokenizer file, each distinct word encoded once by its BPE model.

    The file's normaliser is NFC, runs of white space to one space, lower case; its pre-tokenizer takes letter runs, single numbers
    and runs of other characters. These are found for many texts at once with numpy; texts with contractions or with the strings
    of special tokens go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import re
        import unicodedata

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kinds = {"L": 1, "N": 2}
        self.kind = np.array([kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(0x110000)], np.uint8)
        for i in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            self.kind[i] = 0
        self.kind[0x10FFFF] = 4
        self.apart = re.compile(CONTRACTION).search
        self.beyond = re.compile("[^\x00-\u024f]").search
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.visible = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}  # the byte-level alphabet
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.start, self.flat = array.array("q", [0]), array.array("I")

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, without an end mark, in order. Null is empty."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
                chars += len(texts[to] or "")
                to += 1
            yield from self._some(texts[at:to])
            at = to

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        out: dict[int, np.ndarray] = {}
        clean = []
        for i, t in enumerate(texts):
            t = t or ""
            if "<|" in t or SENTINEL in t or ("'" in t and self.apart(t.lower())):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                t = ""
            elif not t.isascii() and self.beyond(t):
                t = self.tokenizer.normalizer.normalize_str(t)
            else:
                t = t.lower()
            clean.append(t)
        joined = SENTINEL.join(clean) + SENTINEL
        u = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[u]
        single = (kind == 2) | (kind == 4)
        new = np.ones(len(u), bool)
        new[1:] = kind[1:] != kind[:-1]
        starts = np.flatnonzero((new | single) & (kind != 0))
        last = np.ones(len(u), bool)
        last[:-1] = new[1:]
        ends = np.flatnonzero((last | single) & (kind != 0)) + 1
        p = prefix_hash(u)
        h = mixed((p[ends] - p[starts]) * powers(len(p))[1][starts])
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index) > KNOWN:
            self.forget()
        index = self.index
        known = np.empty(len(first), np.int64)
        for k, (x, s, e) in enumerate(zip(h[first].tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
            if (i := index.get(x)) is None:
                w = joined[s:e]
                self.flat.extend([0] if w == SENTINEL else [t.id for t in self.model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin1").translate(self.visible))])
                i = index[x] = len(self.start) - 1
                self.start.append(len(self.flat))
            known[k] = i
        start, flat = np.frombuffer(self.start, np.int64), np.frombuffer(self.flat, np.uint32)  # gone when this ends, so that the arrays can grow
        which = known[back]
        n = start[which + 1] - start[which]
        total = np.cumsum(n)
        ids = flat[np.repeat(start[which] - (total - n), n) + np.arange(total[-1])]
        cuts = total[np.flatnonzero(kind[starts] == 4)]  # behind each end mark
        begins = np.concatenate(([0], cuts[:-1]))
        return [out.get(i, ids[b : e - 1]) for i, (b, e) in enumerate(zip(begins.tolist(), cuts.tolist(), strict=True))]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, limit: int = LIMIT, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit bytes): each document's ids and an end id 0, cut at limit.

    The path is where each executor finds the tokenizer file; None is the installed package's.
    """

    def cut(batches):
        w = words(path or tokenizer_path())
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            size = max(1, min(1024, len(texts)))
            for at in range(0, len(texts), size):
                rows: list[list] = [[], [], [], [], [], []]
                for i, ids in enumerate(w.ids(texts.slice(at, size).to_pylist()), at):
                    full = np.append(ids, np.uint32(0)).astype("<u4", copy=False)
                    for piece, start in enumerate(range(0, len(full), limit)):
                        part = full[start : start + limit].tobytes()
                        for column, value in zip(rows, (i, piece, start, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(value)
                out = [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out, names = [*out, pa.array(rows[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class Complements:
    """Which one, two or three of the lengths there add up to a sum: the index that gaps are looked up in.

    Pairs lie sorted by their sum, the larger part first; a triple's sum leads to its largest parts x, and each of these to the
    pairs that sum up to the rest and have no part above x.
    """

    def __init__(self, lengths: np.ndarray, limit: int):
        x, y = np.meshgrid(lengths, lengths, indexing="ij")
        fine = (x >= y) & (x + y < limit)
        x, y = x[fine], y[fine]
        order = np.lexsort((-x, x + y))
        self.x, self.y = x[order], y[order]
        self.at = np.searchsorted((x + y)[order], np.arange(limit + 2))
        least = np.full(limit + 1, limit + 1)  # the smallest larger part of the pairs with a sum
        np.minimum.at(least, self.x + self.y, self.x)
        z, t = np.meshgrid(lengths, np.arange(limit), indexing="ij")
        fine = (z + t < limit) & (least[t] <= z)
        z, total = z[fine], (z + t)[fine]
        order = np.lexsort((-z, total))
        self.z, self.z_at = z[order], np.searchsorted(total[order], np.arange(limit + 2))

    def pairs(self, total: int, most: int) -> list[tuple[int, int]]:
        s = slice(self.at[total], self.at[total + 1])
        return [(x, y) for x, y in zip(self.x[s].tolist(), self.y[s].tolist(), strict=True) if x <= most]

    def largest(self, total: int, most: int) -> list[int]:
        return [z for z in self.z[self.z_at[total] : self.z_at[total + 1]].tolist() if z <= most]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences have each, that use up all counts; no pattern's sum is above limit.

    Longest first, a length's gap is looked up among the single lengths, then in the indexes of pair sums and of triple sums; a
    combination that exactly fills it is taken as often as the counts allow, so the work depends on the number of lengths, not on the
    number of pieces. What has no exact complement is filled by best fit: the longest length that fits, again and again.
    """
    count = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        count[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*pattern: int) -> bool:
        """As often as it can be; False: not once."""
        own, times = np.unique(pattern, return_counts=True)
        m = int((count[own] // times).min())
        if m:
            count[own] -= m * times
            out.append((pattern, m))
        return m > 0

    if count[limit]:
        take(limit)
    index = Complements(np.flatnonzero(count), limit)
    for big in np.flatnonzero(count)[::-1].tolist():
        gap = limit - big
        if count[big] and count[gap]:
            take(big, gap)
        for x, y in index.pairs(gap, big) if count[big] else ():
            if count[x] and count[y] and take(big, x, y) and not count[big]:
                break
        for x in index.largest(gap, big) if count[big] else ():
            if not count[big]:
                break
            for y, z in index.pairs(gap - x, x) if count[x] else ():
                if count[y] and count[z] and take(big, x, y, z) and not (count[big] and count[x]):
                    break
    while len(there := np.flatnonzero(count)):
        pattern, gap, used = [], limit, {}
        while gap:
            fit = there[: np.searchsorted(there, gap, "right")]
            fit = next((int(x) for x in fit[::-1] if count[x] > used.get(int(x), 0)), 0)
            if not fit:
                break
            again = max(1, min(gap // fit, int(count[fit]) - used.get(fit, 0)))
            pattern += [fit] * again
            used[fit] = used.get(fit, 0) + again
            gap -= fit * again
        take(*pattern)
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], limit: int = LIMIT) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: runs of ranks, by length, with the first sequence and the offset of each run."""
    taken: dict[int, int] = {}
    runs, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            runs.append((length, rank, sequence, offset))
            taken[length] = rank + times
            offset += length
        sequence += times
    runs.sort()
    a = np.array(runs, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """cut (a stored table with doc_id, piece, length, ids_crc32) and sequence_id, offset.

    Only the histogram of lengths (at most limit rows) meets on the driver, and only runs of ranks per length (a bound that limit
    sets) go out. Pieces of a length are ranked in hash buckets whose counts are summed up before, so a length that a third of
    all pieces has is no hot task.
    """
    spark = cut.sparkSession
    buckets = 8 * parts(spark)
    b = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = written(b.groupBy("length", "_b").agg(F.count("*").alias("_n")), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    where = slots(plan(counts, limit), limit)
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = b.withColumn("_r", within).join(base, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_r") - 1)
    ranked = ranked.select(*cut.columns, "_rank")
    shift = np.int64(1) << 40
    sent = spark.sparkContext.broadcast((where["length"] * shift + where["rank"], where["rank"], where["sequence"], where["offset"]))
    names = cut.columns

    def assign(batches):
        key, rank, sequence, offset = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            r = batch.column("_rank").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() * shift + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(assign), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def packed(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Pieces of all documents and their places. Null text: only the end id. An empty table gives an empty result; repeated rows
    are packed as often as they are there; other columns of docs play no part."""
    return pack(written(pieces(docs, limit, path), "pieces"), limit)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
