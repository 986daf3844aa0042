"""Suffix-array dedup: bytes inside strings of 100 bytes that start earlier in the corpus too are removed.

Which strings may repeat is narrowed down in steps that lose none. Every window of WIDTH bytes has an anchor, its least GRAM-byte gram,
by content alone; windows of anchors that occur once are out. So equal windows stand alike around equal grams, and stretches of
windows around one anchor, sent by their anchor, meet all their equals. There each is trimmed to what it shares with any other to
the left and to the right; a suffix array by grouping construction over 16-byte blocks, counted from the anchor, then brings equal
windows together, compared byte by byte, and all but the earliest of each are answered. Blocks counted from the anchor are enough: equal
windows have their anchor at one place, so their blocks begin alike.

A gram that more than HOT parts have may stand in any number of different surroundings. Its windows first meet as 32-bit hashes, dealt
by hash, and only those whose hash occurs twice are sent, as stretches; equal ones once a part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import buffers, mixed, parts, powers, prefix_hash, released, span_hash, table, written
from manyways.llm.suffixes import suffix_array

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM + 1
BLOCK = 16
SIDE = 80  # a multiple of BLOCK, for the SPAN - 1 bytes that a window can have on one side of its anchor
ROW = SIDE + GRAM + SIDE
PART_BYTES = 6_000_000
BUCKET_BYTES = 12_000_000
HOT = 256
CHUNK = 500_000
FACTS = "part int, kind int, bucket int, data binary"


@dataclass
class Anchors:
    """Of each anchor: its gram's hash, its place, and the first and last start of its windows. Places count from the part's start."""

    gram: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    prefix: np.ndarray  # prefix hashes of the piece


def anchors(b: np.ndarray, off: np.ndarray) -> Anchors | None:
    """Anchors of all windows of texts (bytes between offsets). Among equal least grams the leftmost counts."""
    n = len(b) - WIDTH + 1
    if n <= 0:
        return None
    p = prefix_hash(b)
    g = mixed((p[GRAM:] - p[:-GRAM]) * powers(len(p))[1][: len(p) - GRAM])
    key = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    rows = -(-len(key) // SPAN)
    padded = np.full(rows * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    ahead = np.minimum.accumulate(padded.reshape(rows, SPAN), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(rows, SPAN)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & np.uint64(0xFFFFFFFF)
    fine = np.repeat(off[1:], np.diff(off))[:n] >= np.arange(n) + WIDTH
    s = np.flatnonzero(fine)
    if not len(s):
        return None
    a = least[s].astype(np.int64)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(s)) - 1
    return Anchors(g[a[begins]] | np.uint64(1), a[begins], s[begins], s[ends], p)


class Part:
    """The documents of one part, by doc_id and text, their bytes one behind the other."""

    def __init__(self, rows: pa.Table):
        order = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = order.column("doc_id")
        self.keys = np.array([np.iinfo(np.int64).max if x is None else x for x in self.ids.to_pylist()], np.int64)
        data, off = [], [np.zeros(1, np.int64)]
        for chunk in order.column("text").chunks:
            b, o, _ = buffers(chunk)
            data.append(b)
            off.append(o[1:] + off[-1][-1])
        self.off = np.concatenate(off)
        self.b = np.concatenate(data) if data else np.zeros(0, np.uint8)

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Where a piece starts, its bytes and its offsets. Long texts are cut; pieces overlap by a window less one byte."""
        cuts = []
        for a, z in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True):
            for s in range(a, max(z - WIDTH + 1, a + 1), CHUNK):
                cuts.append((s, min(z, s + CHUNK + WIDTH - 1)))
        i = 0
        while i < len(cuts):
            j, total = i, 0
            while j < len(cuts) and (j == i or total + cuts[j][1] - cuts[j][0] <= CHUNK) and (j == i or cuts[j][0] >= cuts[j - 1][1]):
                total += cuts[j][1] - cuts[j][0]
                j += 1
            start, end = cuts[i][0], cuts[j - 1][1]
            yield start, self.b[start:end], np.array([c[0] for c in cuts[i:j]] + [end]) - start
            i = j

    def anchored(self) -> Iterator[tuple[int, np.ndarray, Anchors]]:
        for start, b, off in self.pieces():
            if (a := anchors(b, off)) is not None:
                yield start, b, a


def _starts(a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """All windows' starts and which anchor each has."""
    n = a.last - a.first + 1
    who = np.repeat(np.arange(len(n)), n)
    return a.first[who] + np.arange(len(who)) - (np.cumsum(n) - n)[who], who


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


def _batch(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"data": pa.binary(), "doc_id": pa.int64()}
    return pa.table({n: pa.array([r[i] for r in rows], kinds.get(n, pa.int32())) for i, n in enumerate(names)})


def grams_of(part: int, p: Part, buckets: int) -> list[tuple]:
    """(part, kind, bucket, data): distinct grams; the lowest bit says whether the part has one twice or more."""
    found = [a.gram for _, _, a in p.anchored()]
    if not found:
        return []
    u, n = np.unique(np.concatenate(found), return_counts=True)
    u = u - (n == 1).astype(np.uint64)
    bucket = (u >> np.uint64(1)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    u, bucket = u[order], bucket[order]
    return [(part, 0, k, u[s].tobytes()) for k, s in _by_bucket(bucket, buckets)]


def repeated_grams(rows: list[tuple[int, bytes]], hot: int = HOT) -> list[tuple]:
    """Of (part, data) of one bucket: what each part has of the grams that occur twice or more; the lowest bit is off for those of more
    than `hot` parts."""
    each = [np.frombuffer(d, np.uint64) for _, d in rows]
    u, back = np.unique(np.concatenate(each) | np.uint64(1), return_inverse=True)
    n = np.bincount(back, np.concatenate([1 + (e & np.uint64(1)).astype(np.int64) for e in each]))
    spread = np.bincount(back) > hot
    out = []
    for part, e in zip((r[0] for r in rows), each, strict=True):
        full = e | np.uint64(1)
        at = np.searchsorted(u, full)
        keep = n[at] >= 2
        if keep.any():
            out.append((part, 0, 0, (full[keep] - spread[at[keep]].astype(np.uint64)).tobytes()))
    return out


def _known(grams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted repeated grams of few parts, and of many."""
    g = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in grams)]))
    few = (g & np.uint64(1)).astype(bool)
    return g[few], g[~few] | np.uint64(1)


def _among(a: Anchors, known: np.ndarray) -> Anchors | None:
    if not len(known):
        return None
    keep = known[np.minimum(np.searchsorted(known, a.gram), len(known) - 1)] == a.gram
    return Anchors(a.gram[keep], a.at[keep], a.first[keep], a.last[keep], a.prefix) if keep.any() else None


class Windows:
    """A part's windows of repeated anchors that many parts have, and their places in the hash space: bucket and 32 bits."""

    def __init__(self, chunks: list[tuple[int, Anchors]], buckets: int):
        self.buckets, self.chunks, keys = buckets, [], []
        for start, a in chunks:
            s, who = _starts(a)
            h = span_hash(a.prefix, s, s + WIDTH)
            keys.append(((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)))
            self.chunks.append((start, a, s, who))
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        self.unique, self.back, self.count = np.unique(self.keys, return_inverse=True, return_counts=True)
        self.bucket = self.unique >> np.uint64(32)

    def rows(self, part: int) -> list[tuple]:
        out = []
        for k, s in _by_bucket(self.bucket, self.buckets):
            low = (self.unique[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((part, 1, k, np.uint32(len(low)).tobytes() + low.tobytes() + np.packbits(self.count[s] > 1).tobytes()))
        return out

    def repeated(self, bits: list[tuple[int, bytes]]) -> np.ndarray:
        """Which of the windows occur twice or more, by the buckets' answers."""
        fine = np.zeros(len(self.unique), bool)
        answers = dict(bits)
        for k, s in _by_bucket(self.bucket, self.buckets):
            if k in answers:
                fine[s] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=s.stop - s.start).astype(bool)
        return fine[self.back] if len(self.keys) else np.zeros(0, bool)


def repeated_windows(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple]:
    each, twice = [], []
    for _, d in rows:
        n = int(np.frombuffer(d, np.uint32, 1)[0])
        each.append(np.frombuffer(d, np.uint32, n, 4))
        twice.append(np.unpackbits(np.frombuffer(d, np.uint8, offset=4 + 4 * n), count=n))
    u, back = np.unique(np.concatenate(each), return_inverse=True)
    fine = np.bincount(back, 1 + np.concatenate(twice)) >= 2
    cuts = np.cumsum([len(e) for e in each])[:-1]
    return [(part, 1, bucket, np.packbits(f).tobytes()) for (part, _), f in zip(rows, np.split(fine[back], cuts), strict=True) if f.any()]


_HEAD = np.dtype([("doc", "<i8"), ("index", "<i4"), ("start", "<i4"), ("anchor", "u1"), ("size", "u1")])
_GONE = np.dtype([("index", "<i4"), ("start", "<i4"), ("bits", "u1", (9,))])


def _runs(w: Windows, fine: np.ndarray) -> Iterator[tuple[int, Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each chunk: first and last starts of runs of repeated windows around one anchor, and which anchor."""
    at = 0
    for start, a, s, who in w.chunks:
        good = np.flatnonzero(fine[at : at + len(s)])
        at += len(s)
        if len(good):
            new = np.concatenate(([True], (good[1:] != good[:-1] + 1) | (who[good[1:]] != who[good[:-1]])))
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(good)) - 1
            yield start, a, s[good[begins]], s[good[ends]], who[good[begins]]


def stretches(part: int, p: Part, runs: Iterator, buckets: int) -> list[tuple]:
    """(part, kind, bucket of the anchor, data): stretches of windows around one anchor (kind 2); of equal ones, the part's first. All
    windows of the others stand earlier: their first and last starts are what remains of them (kind 3)."""
    heads, grams, hashes, places = [], [], [], []
    for start, a, first, last, k in runs:
        x, y = first, last + WIDTH
        doc = np.searchsorted(p.off, x + start, "right") - 1
        head = np.zeros(len(x), _HEAD)
        head["doc"], head["index"], head["start"], head["anchor"], head["size"] = p.keys[doc], doc, x + start - p.off[doc], a.at[k] - x, y - x
        heads.append(head)
        grams.append(a.gram[k])
        hashes.append(mixed(span_hash(a.prefix, x, y) + head["anchor"].astype(np.uint64)))
        places.append(x + start)
    if not heads:
        return []
    head, gram, place = np.concatenate(heads), np.concatenate(grams), np.concatenate(places)
    first = np.unique(np.concatenate(hashes), return_index=True)[1]
    out, later = [], np.ones(len(head), bool)
    later[first] = False
    if later.any():
        out.append((part, 3, 0, np.column_stack((place[later], place[later] + head["size"][later] - WIDTH)).astype(np.int64).tobytes()))
    bucket = (gram[first] >> np.uint64(1)) % np.uint64(buckets)
    order = np.lexsort((first, bucket))
    first, bucket = first[order], bucket[order]
    for k, s in _by_bucket(bucket, buckets):
        chosen = head[first[s]]
        size = chosen["size"].astype(np.int64)
        at = np.repeat(place[first[s]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out.append((part, 2, k, np.uint32(len(chosen)).tobytes() + chosen.tobytes() + p.b[at].tobytes()))
    return out


def _aligned(head: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Stretches as rows of ROW bytes with their anchors at SIDE, zeros around them."""
    size, anchor = head["size"].astype(np.int64), head["anchor"].astype(np.int64)
    out = np.zeros((len(head), ROW), np.uint8)
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(head)), size)
    out[which, np.arange(len(flat)) - begin[which] + (SIDE - anchor)[which]] = flat
    return out


def _shared(side: np.ndarray, key: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many bytes, from an anchor on, each row has like another row of the same key. side: the bytes, nearest first; room: how
    many of them a row has. Sorted, a row's longest common prefix with any other is that with a neighbour; rows whose zeros are
    partly room left over stand before those whose zeros are bytes."""
    words = np.ascontiguousarray(side).view(">u8").astype(np.uint64)
    order = np.lexsort((room, *words.T[::-1], key))
    a, b = order[:-1], order[1:]
    differ = side[a] != side[b]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    common = np.where(key[a] == key[b], np.minimum(common, np.minimum(room[a], room[b])), 0)
    out = np.zeros(len(key), np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def earliest(rows: list[tuple[int, bytes]]) -> list[tuple]:
    """Of (part, data) with stretches of one bucket: for each part, the windows that stand earlier too.

    Each stretch is trimmed to the bytes on either side of its anchor that another stretch of the anchor has too; no window beyond
    them repeats. Equal trimmed stretches count once, the earliest of them: all windows of the others stand earlier. Where an
    anchor is left with several, these are written in blocks of BLOCK bytes from their anchors on, with an end mark each, and the
    suffixes that start at a block are ordered by suffix_array. For each number r of bytes that a window has before its first whole
    block, windows are equal if their suffixes share WIDTH - r bytes, runs in that order, and the r bytes before.
    """
    heads, flats, owners = [], [], []
    for part, d in rows:
        n = int(np.frombuffer(d, np.uint32, 1)[0])
        heads.append(np.frombuffer(d, _HEAD, n, 4))
        flats.append(np.frombuffer(d, np.uint8, offset=4 + n * _HEAD.itemsize))
        owners.append(np.full(n, part))
    head, owner = np.concatenate(heads), np.concatenate(owners)
    m = _aligned(head, np.concatenate(flats))
    order = np.lexsort((head["start"], head["index"], head["doc"]))  # the corpus's order
    head, owner, m = head[order], owner[order], m[order]
    size, anchor = head["size"].astype(np.int64), head["anchor"].astype(np.int64)
    key = np.zeros(len(head), np.uint64)
    for word in np.ascontiguousarray(m[:, SIDE : SIDE + GRAM]).view(">u8").astype(np.uint64).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + word)
    right, left = _shared(m[:, SIDE + GRAM :], key, size - anchor - GRAM), _shared(m[:, SIDE - 1 :: -1], key, anchor)
    some = np.flatnonzero(left + GRAM + right >= WIDTH)
    if not len(some):
        return []
    head, owner, m, key, left, right, anchor = (x[some] for x in (head, owner, m, key, left, right, anchor))
    column = np.arange(ROW)
    m = np.where((column >= (SIDE - left)[:, None]) & (column < (SIDE + GRAM + right)[:, None]), m, 0).astype(np.uint8)
    _, first, back = np.unique(np.column_stack((m, left.astype(np.uint8), right.astype(np.uint8))).view(f"V{ROW + 2}").ravel(), return_index=True, return_inverse=True)
    again = first[back] != np.arange(len(m))
    lo, hi = anchor - left, anchor + GRAM + right - WIDTH  # places of the trimmed stretch's windows in the stretch
    place = np.arange(SPAN)
    gone = again[:, None] & (place >= lo[:, None]) & (place <= hi[:, None])
    chosen = np.sort(first)
    _, of, n = np.unique(key[chosen], return_inverse=True, return_counts=True)
    chosen = chosen[n[of] > 1]
    if len(chosen):
        w, c = _later(m[chosen], left[chosen], right[chosen])
        gone[chosen[w], c - SIDE + anchor[chosen[w]]] = True
    some = np.flatnonzero(gone.any(axis=1))
    answer = np.zeros(len(some), _GONE)
    answer["index"], answer["start"], answer["bits"] = head["index"][some], head["start"][some], np.packbits(gone[some], axis=1)
    by = np.argsort(owner[some], kind="stable")
    edges = np.flatnonzero(np.diff(owner[some][by])) + 1
    return [(int(owner[some[g[0]]]), 2, 0, answer[g].tobytes()) for g in np.split(by, edges) if len(g)]


def _later(m: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first columns of the windows of aligned stretches (in the corpus's order) that an earlier row has too."""
    lead = left % BLOCK  # bytes before the first block
    begin, end = SIDE - left + lead, SIDE + GRAM + right
    blocks = -(-(end - begin) // BLOCK)
    n = blocks + 1
    total = np.cumsum(n)
    owner_of = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(total[-1])) - (total - n)[owner_of]
    real = place < blocks[owner_of]
    column = begin[owner_of] + BLOCK * place
    words = m.view(">u8").astype(np.uint64)
    cell = words.reshape(len(m), -1, BLOCK // 8)[owner_of[real], column[real] // BLOCK]
    by = np.lexsort(cell.T[::-1])
    new = np.concatenate(([True], (cell[by][1:] != cell[by][:-1]).any(axis=1)))
    sequence = np.zeros(len(place), np.int64)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    sequence[real] = rank
    value = np.vstack((np.zeros((1, BLOCK // 8), np.uint64), cell[by][new]))
    order = suffix_array(sequence)
    order = order[real[order]]
    which, at = owner_of[order], column[order]
    room = end[which] - at
    common = np.zeros(len(order), np.int64)  # bytes shared with the suffix before
    going = np.ones(max(len(order) - 1, 0), bool)
    x, y = order[:-1], order[1:]
    for k in range(WIDTH // BLOCK + 1):
        i, j = np.minimum(x + k, len(sequence) - 1), np.minimum(y + k, len(sequence) - 1)
        a, z = sequence[i], sequence[j]
        going &= (a > 0) & (z > 0)
        same = going & (a == z)
        differ = going & ~same
        if differ.any():
            v = (value[a[differ]] ^ value[z[differ]]).astype(">u8").view(np.uint8)
            common[1:][differ] += (v != 0).argmax(axis=1)
        common[1:][same] += BLOCK
        going = same
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    rows, columns = [], []
    for r in range(BLOCK):
        ok = np.flatnonzero((at - r >= SIDE - left[which]) & (at - r <= SIDE) & (room >= WIDTH - r) & (at - r + WIDTH >= SIDE + GRAM))
        if not len(ok):
            continue
        run = np.cumsum(common < WIDTH - r)[ok]
        w, s = which[ok], at[ok] - r
        prior = np.zeros((BLOCK // 8, len(ok)), np.uint64)
        for k in range(r):
            prior[k // 8] = prior[k // 8] << np.uint64(8) | m[w, s + k].astype(np.uint64)
        by = np.lexsort((w, *prior, run))
        same = (run[by][1:] == run[by][:-1]) & (prior[:, by][:, 1:] == prior[:, by][:, :-1]).all(axis=0)
        later = by[1:][same]
        rows.append(w[later])
        columns.append(s[later])
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64),) * 2


def outcome(p: Part, runs: list[bytes], gone: list[bytes]) -> list[tuple]:
    """doc_id's position, n_bytes, n_removed, n_spans, kept bytes of each document of a part."""
    edge = np.zeros(len(p.b) + 2, np.int32)
    for d in runs:
        r = np.frombuffer(d, np.int64).reshape(-1, 2)
        np.add.at(edge, r[:, 0], 1)
        np.add.at(edge, r[:, 1] + 1, -1)
    again = np.cumsum(edge[:-1]) > 0
    for d in gone:
        k = np.frombuffer(d, _GONE)
        i, j = np.nonzero(np.unpackbits(k["bits"], axis=1, count=SPAN))
        again[p.off[k["index"][i]] + k["start"][i] + j] = True
    edge = np.zeros(len(p.b) + WIDTH + 1, np.int32)
    s = np.flatnonzero(again)
    edge[s] += 1
    edge[s + WIDTH] -= 1
    covered = np.cumsum(edge[: len(p.b)]) > 0
    out = []
    for i, (a, z) in enumerate(zip(p.off[:-1].tolist(), p.off[1:].tolist(), strict=True)):
        g = covered[a:z]
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        out.append((i, z - a, int(g.sum()), spans, p.b[a:z][~g].tobytes()))
    return out


def removed(docs: DataFrame, keep_text: bool = False, part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the rest's bytes) of every row of docs.

    A null text is empty. Rows of one doc_id count in the order of their texts; a null doc_id comes last. Texts under 100 bytes lose
    nothing. Documents lie in parts by a hash of doc_id, about part_bytes each, and what parts and buckets of hashes tell each other
    are packed rows, one for each pair that has something to tell, so never more than there are anchors; equal content is sent once
    a part. A very long text is whole in its part and is worked on in pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    several, buckets = max(parts(spark), math.ceil(total / part_bytes)), max(parts(spark), math.ceil(total / bucket_bytes))
    held = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(several)).cast("int"))
    names = ["part", "kind", "bucket", "data"]

    def first(t: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"), released():
            return _batch(grams_of(t.column("part")[0].as_py(), Part(t), buckets), names)

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        given = list(zip(t.column("part").to_pylist(), t.column("data").to_pylist(), strict=True))
        with np.errstate(over="ignore"), released():
            return _batch(repeated_grams(given, hot) if kind == 0 else repeated_windows(bucket, given) if kind == 1 else earliest(given), names)

    def of_kind(facts: pa.Table, kind: int, *columns: str) -> list:
        use = facts.filter(pa.compute.equal(facts.column("kind"), kind)) if facts.num_rows else facts
        lists = [use.column(c).to_pylist() for c in columns]
        return lists[0] if len(lists) == 1 else list(zip(*lists, strict=True))

    def chunks(p: Part, known: np.ndarray) -> list[tuple[int, Anchors]]:
        return [(start, x) for start, _, a in p.anchored() if (x := _among(a, known)) is not None]

    def second(t: pa.Table, facts: pa.Table) -> pa.Table:
        if not t.num_rows or not facts.num_rows:
            return _batch([], names)
        with np.errstate(over="ignore"), released():
            part, p = t.column("part")[0].as_py(), Part(t)
            few, many = _known(of_kind(facts, 0, "data"))
            wide: list[tuple[int, Anchors]] = []

            def runs():
                for start, _, a in p.anchored():
                    if (x := _among(a, many)) is not None:
                        wide.append((start, x))
                    if (x := _among(a, few)) is not None:
                        yield start, x, x.first, x.last, np.arange(len(x.at))

            out = stretches(part, p, runs(), buckets)
            return _batch(out + (Windows(wide, buckets).rows(part) if wide else []), names)

    def third(t: pa.Table, facts: pa.Table) -> pa.Table:
        if not t.num_rows or not facts.num_rows:
            return _batch([], names)
        with np.errstate(over="ignore"), released():
            part, p = t.column("part")[0].as_py(), Part(t)
            w = Windows(chunks(p, _known(of_kind(facts, 0, "data"))[1]), buckets)
            return _batch(stretches(part, p, _runs(w, w.repeated(of_kind(facts, 1, "bucket", "data"))), buckets), names)

    def last(t: pa.Table, facts: pa.Table) -> pa.Table:
        with released():
            p = Part(t) if t.num_rows else None
            out = outcome(p, of_kind(facts, 3, "data"), of_kind(facts, 2, "data")) if p is not None else []
            ids = p.ids.to_pylist() if p is not None else []
            columns = {"doc_id": pa.array([ids[o[0]] for o in out], pa.int64())}
            columns |= {n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("n_bytes", "n_removed", "n_spans"), 1)}
            columns["kept_sha256"] = pa.array([hashlib.sha256(o[4]).hexdigest() for o in out], pa.string())
            if keep_text:
                columns["kept"] = pa.array([o[4] for o in out], pa.binary())
            return pa.table(columns)

    def asked(df: DataFrame) -> DataFrame:
        return df.groupBy("kind", "bucket").applyInArrow(meet, FACTS)

    def told(facts: DataFrame, step, schema: str = FACTS) -> DataFrame:
        return held.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(step, schema)

    grams = written(asked(held.groupBy("part").applyInArrow(first, FACTS)), "grams")
    sent = written(told(grams, second), "stretches")
    answers = written(asked(sent.filter("kind < 3")), "answers")
    facts = sent.filter("kind = 3").union(answers.filter("kind = 2"))
    if sent.filter("kind = 1").limit(1).count():
        more = written(told(grams.union(answers.filter("kind = 1")), third), "more-stretches")
        facts = facts.union(more.filter("kind = 3")).union(written(asked(more.filter("kind = 2")), "more-answers"))
    return told(facts, last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
