"""Near-duplicate groups: an LSH forest of MinHash signatures proposes pairs, full shingle sets confirm them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import buffers, discard, mixed, parts, powers, prefix_hash, released, table, trimmed, written

TREES = 16
STRIDE = 4
HASHES = TREES * STRIDE
DEPTH = 3
TAIL = 4
NEAR = 8
FAR = 3
REGION = 512
TEXTS = 1000
#: Texts, and pairs of texts, that a Python worker gets at once.
ROWS = 1000
PAIRS = 100
ALIKE = 0.5
CHUNK = 1_000_000
FILTER_WORDS = 1 << 20
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(1, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each text (bytes between offsets): its sorted, distinct 64-bit shingle hashes. A-Z are lower-cased; words are runs
    of what isn't ASCII white space; a text of fewer words is one shingle; one without words has none."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        off = offsets[at : to + 1] - offsets[at]
        b = _LOW[data[offsets[at] : offsets[to]]]
        word = ~_SEP[b]
        start = word.copy()
        start[1:] &= ~word[:-1]
        begins = off[:-1][off[:-1] < len(b)]
        start[begins] = word[begins]
        starts = np.flatnonzero(start)
        end = word.copy()
        end[:-1] &= ~word[1:] | start[1:]
        ends = np.flatnonzero(end) + 1
        p = prefix_hash(b)
        h = mixed((p[ends] - p[starts]) * powers(len(p))[1][starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, off)
        if len(h) >= width:
            s = np.zeros(len(h) - width + 1, np.uint64)
            for i in range(width):
                s = (s + h[i : len(h) - width + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
                s ^= s >> np.uint64(29)
            s = mixed(s)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= width:
                yield np.unique(s[a : z - width + 1])
            elif z > a:
                x = np.uint64(z - a)
                for w in h[a:z]:
                    x = (x * np.uint64(0xD6E8FEB86659FD93)) ^ w
                yield mixed(np.atleast_1d(x))
            else:
                yield np.zeros(0, np.uint64)
        at = to


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima over a set of 64-bit hashes."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        x, y = (s[i : i + 4096] >> np.uint64(32)).astype(np.uint32), s[i : i + 4096].astype(np.uint32)
        m = _A[:, None] * x
        m += _B[:, None] * y
        np.minimum(out, m.min(axis=1), out=out)
    return out


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets; null for none) and signature."""

    def each(batches):
        for batch in batches:
            data, off, _ = buffers(batch.column(1))
            counts, ids, signatures = [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(data, off, width):
                    counts.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_id", "signature"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(trimmed(each), "doc_id long, n_shingles long, set_id binary, signature binary")


def regions(key: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of (region, key): a number that rows of one adaptive region share, and whether it is small.

    The common prefix of neighbours gives the regions of each depth, from DEPTH values to all of them. A row belongs to the least
    deep region that has NEAR + 1 rows at most, so sparse parts of a tree stay shallow and crowded ones go deeper; where even the
    deepest region has more, that is the row's.
    """
    n = len(region)
    same = region[1:] == region[:-1]
    lcp = np.where(same, DEPTH, 0)
    going = same.copy()
    for i in range(key.shape[1]):
        going &= key[1:, i] == key[:-1, i]
        lcp += going
    own, small, at = np.zeros(n, np.int64), np.zeros(n, bool), 0
    for depth in range(DEPTH, DEPTH + key.shape[1] + 1):
        begins = np.flatnonzero(np.concatenate(([True], lcp < depth)))
        size = np.diff(np.append(begins, n))
        run = np.repeat(np.arange(len(begins)), size)
        rows = np.repeat(size, size) <= NEAR + 1
        new = rows & ~small if depth < DEPTH + key.shape[1] else ~small
        own[new] = at + run[new]
        small |= rows
        at += len(begins)
    return own, small


def forest(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees' rows (region, key, id), stored, and candidate pairs (a, b), a < b, of doc_ids.

    Each tree is the order of all signatures read from another place on, cyclically. Candidates are the rows next to each other in
    an order, which share the longest prefixes, and all pairs of small adaptive regions (see regions()); of a large one that can't
    go deeper, rows with the FAR next. Orders are dealt by range, so a large region is spread over tasks; rows at the borders of the
    ranges are paired in a second step.
    """
    spark = sets.sparkSession

    def keys(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, HASHES)
            with np.errstate(over="ignore"):
                for t in range(TREES):
                    at = (t * STRIDE + np.arange(DEPTH + TAIL)) % HASHES
                    h = np.full(n, t + 1, np.uint64)
                    for i in at[:DEPTH]:
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
                    key = np.ascontiguousarray(s[:, at[DEPTH:]]).astype(">u4").view(f"S{4 * TAIL}").ravel()
                    key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * TAIL), n, [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), key, batch.column(0)], ["region", "key", "id"])

    def pair(region: np.ndarray, key: np.ndarray, ids: np.ndarray):
        own, small = regions(key, region)
        for step in range(1, min(NEAR, len(ids) - 1) + 1):
            hit = own[step:] == own[:-step]
            if step > FAR:
                hit &= small[:-step]
            if step == 1:
                hit = region[1:] == region[:-1]
            at = np.flatnonzero(hit)
            if len(at):
                yield np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step])

    def within(batches):
        """Pairs inside a range; then its first and last rows, with the range's number, as rows without b."""
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        region, ids = (np.concatenate([b.column(i).to_numpy() for b in found]) for i in (0, 2))
        raw = [x for b in found for x in b.column(1).to_pylist()]
        key = np.frombuffer(b"".join(raw), ">u4").reshape(-1, TAIL)
        out = list(pair(region, key, ids))
        if out:
            seen = np.unique(np.column_stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=0)
            seen = seen[seen[:, 0] != seen[:, 1]]
            none = [pa.nulls(len(seen), k) for k in (pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(seen[:, 0]), pa.array(seen[:, 1]), *none], ["a", "b", "region", "key", "range"])
        edge = np.unique(np.concatenate((np.arange(min(NEAR, len(ids))), np.arange(max(0, len(ids) - NEAR), len(ids)))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.nulls(len(edge), pa.int64()), pa.array(region[edge]), pa.array([raw[i] for i in edge], pa.binary()), pa.array(np.full(len(edge), here))], ["a", "b", "region", "key", "range"])

    def between(t: pa.Table) -> pa.Table:
        """Pairs of one region's border rows that lie in different ranges, 2 * NEAR - 1 rows apart at most."""
        t = t.sort_by([("range", "ascending"), ("key", "ascending"), ("id", "ascending")])
        ids, where = t.column("id").to_numpy(), t.column("range").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(2 * NEAR, len(ids))):
            at = np.flatnonzero((where[step:] != where[:-step]) & (ids[step:] != ids[:-step]))
            a.append(np.minimum(ids[at], ids[at + step]))
            b.append(np.maximum(ids[at], ids[at + step]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    rows = written(sets.select("doc_id", "signature").mapInArrow(trimmed(keys), "region long, key binary, id long"), "forest")
    ordered = rows.repartitionByRange(2 * parts(spark), "region", "key", "id").sortWithinPartitions("region", "key", "id")
    found = written(ordered.mapInArrow(trimmed(within), "a long, b long, region long, key binary, range long"), "pairs")
    border = found.filter("b is null").select(F.col("a").alias("id"), "region", "range", "key")
    cut = border.groupBy("region").agg(F.min("range").alias("low"), F.max("range").alias("high")).filter("low < high").select("region")
    crossing = border.join(cut, "region").groupBy("region").applyInArrow(between, "a long, b long")
    return rows, found.filter("b is not null").select("a", "b").union(crossing).distinct()


def sifted(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and text of the rows of docs whose doc_id may be among those asked for, so that few texts are shuffled.

    A blocked Bloom filter of FILTER_WORDS 64-bit words, a fixed size, goes out; beyond what it can tell apart more rows pass.
    """
    h = F.xxhash64("doc_id")
    bit = lambda at: F.expr(f"shiftleft(1L, cast(pmod(shiftright(_h, {at}), 64) as int))")
    marked = lambda df: df.withColumn("_h", h).withColumn("_word", F.pmod("_h", F.lit(FILTER_WORDS))).withColumn("_bits", bit(24).bitwiseOR(bit(32)).bitwiseOR(bit(40))).drop("_h")
    held = marked(asked).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).toArrow()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[held["_word"].to_numpy()] = held["_bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def sift(batches):
        for batch in batches:
            bits = batch.column(3).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(sent.value[batch.column(2).to_numpy()] & bits == bits))

    rows = marked(docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null"))
    return rows.select("doc_id", "text", "_word", "_bits").mapInArrow(trimmed(sift), "doc_id long, text string")


def unlinked(rows: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """id, mates: pairs of large regions that lie in different components so far: each member outside its region's most frequent
    component, with all other members whose signatures don't rule the link out (it agrees in ALIKE of the hashes or more, six
    standard deviations below what the least similarity gives).

    In small regions all pairs are candidates before; so each pair that shares a region is either confirmed or refused, or
    in one component anyway. Regions are salted by their sizes.
    """
    large = rows.groupBy("region").agg(F.count("*").alias("size")).filter(F.col("size") > NEAR + 1)
    members = rows.select("region", "id").join(large, "region").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = written(members, "members")
    per = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("region").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("several")).filter("several > 1").drop("several")
    mixed_up = members.join(main, "region").join(sets.select(F.col("doc_id").alias("id"), "signature"), "id").withColumn("salts", F.floor(F.col("size") / REGION).cast("int") + 1)
    mixed_up = written(mixed_up, "mixed")
    left = mixed_up.filter("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = mixed_up.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    columns = ["region", "salt", "id", "component", "signature"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and y.num_rows:
            a, b = (np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES) for t in (x, y))
            i, j = x.column("id").to_numpy(), y.column("id").to_numpy()
            c, d = x.column("component").to_numpy(), y.column("component").to_numpy()
            for k in range(len(i)):
                mates = j[((b == a[k]).sum(axis=1) >= ALIKE * HASHES) & (d != c[k])]
                if len(mates):
                    out.append((int(i[k]), mates.tolist()))
        return pa.table({"id": pa.array([o[0] for o in out], pa.int64()), "mates": pa.array([o[1] for o in out], pa.list_(pa.int64()))})

    met = left.select(columns).groupBy("region", "salt").cogroup(right.select(columns).groupBy("region", "salt")).applyInArrow(meet, "id long, mates array<long>")
    return met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("mates"))).alias("mates"))


def confirmed_mates(mates: DataFrame, texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of rows (id, mates): blocks of texts meet the rows with mates among them, and the shared shingles of a row with all of
    a block are counted at once. No pair is a row of its own before it is confirmed, and of the mates of one component in a block one
    link is given, which joins all of them."""
    blocks = max(1, -(-texts.count() // TEXTS))

    def deal(batches):
        for batch in batches:
            out = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.array(m, np.int64)
                where = np.mod(m, blocks)
                out += [(i, int(k), m[where == k].tolist()) for k in np.unique(where)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["doc_id", "block", "mates"])

    def check(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = [], []
        if x.num_rows and y.num_rows:
            with np.errstate(over="ignore"):
                left, right = (list(shingle_sets(*buffers(c.cast(pa.large_string()))[:2], width)) for c in (x.column("text"), y.column("its")))
            size = np.array([len(s) for s in right])
            every, owner = np.concatenate(right), np.repeat(np.arange(len(right)), size)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            ids, of = y.column("mate").to_numpy(), y.column("of").to_numpy()
            for i, s, m in zip(x.column("doc_id").to_pylist(), left, x.column("mates").to_pylist(), strict=True):
                lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=len(right))
                fine = (100 * both >= percent * (len(s) + size - both)) & np.isin(ids, m)
                one = ids[fine][np.unique(of[fine], return_index=True)[1]].tolist()
                a += [min(i, j) for j in one]
                b += [max(i, j) for j in one]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = mates.mapInArrow(trimmed(deal), "doc_id long, block long, mates array<long>").join(texts, "doc_id")
    right = texts.select(F.pmod("doc_id", F.lit(blocks)).cast("long").alias("part"), F.col("doc_id").alias("mate"), F.col("text").alias("its"))
    right = right.join(labels.select(F.col("id").alias("mate"), "component"), "mate", "left").withColumn("of", F.coalesce("component", "mate")).drop("component")
    return dealt.groupBy("block").cogroup(right.groupBy("part")).applyInArrow(check, "a long, b long").distinct()


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return written(sifted(docs, asked).join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts", ROWS)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def check(batches):
        for batch in batches:
            rows = max(1, min(batch.num_rows, PAIRS))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                with np.errstate(over="ignore"):
                    left, right = (shingle_sets(*buffers(part.column(i))[:2], width) for i in (2, 3))
                    fine = []
                    for x, y in zip(left, right, strict=True):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        fine.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_y")), "b")
    return joined.select("a", "b", F.coalesce("_x", F.lit("")).alias("_x"), F.coalesce("_y", F.lit("")).alias("_y")).mapInArrow(trimmed(check), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and component, the least id that links lead to. links (a, b) is a stored table.

    Each round moves every id to the least one among itself and its neighbours, and links that then join an id with itself, or say the same,
    are gone: a large group costs its links once, not once a round. An id that is left after two rounds has taken in another, so the
    number of rounds grows with the logarithm of the ids. Then moves are followed from the last round back. No links or labels come to the driver.
    """
    moves, held = [], None
    while True:
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "moves")
        moves.append(move)
        to = lambda side: move.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))  # noqa: E731, B023
        left = links.join(to("a"), "a").join(to("b"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        links = written(left.distinct(), "left-links")
        if held is not None:
            discard(held)
        held = links
        if not links.limit(1).count():
            break
    discard(held)
    labels = moves.pop()
    while moves:
        move = moves.pop()
        further = written(followed(move, labels), "labels")
        discard(move, labels)
        labels = further
    return labels


def followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """labels (id, component) with components moved on where `further` (id, component) has them; ids that only it has come along."""
    on = further.select(F.col("id").alias("component"), F.col("component").alias("_further"))
    moved = labels.join(on, "component", "left").select("id", F.coalesce("_further", "component").alias("component"))
    return moved.union(further.join(labels, "id", "left_anti").select("id", "component"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id and component of labels after more links (a, b): what is in one component already doesn't link anew."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
    ends = [F.coalesce(f"_{side}", side) for side in "ab"]
    new = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).filter("a <> b").distinct()
    return followed(labels, components(written(new, "new-links")))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Equal sets are one node, so a large group of copies costs no pairs; its links count for all its documents. A null or wordless
    text has no shingles and its own component. Rows of one doc_id belong to the components of their own texts, also where these
    differ; a null doc_id joins no links and is kept. Ids must be whole numbers. Texts of any length are compared whole; other columns play no
    part. An empty table gives an empty result.
    """
    rows = written(shingled(docs, width), "shingled", ROWS)
    sets_of = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y"))
    if not sets_of.filter("x <> y").limit(1).count():
        return _grouped(rows, docs, width, percent)
    # an id with several texts names none of them: numbers stand for the rows, fixed by the written table
    numbered = written(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    alone = numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text")
    known = _grouped(written(shingled(alone, width), "shingled", ROWS), alone, width, percent)
    of_row = known.filter("doc_id is not null").select(F.col("doc_id").alias("_row"), "n_shingles", F.col("component_id").alias("_component"))
    rows = written(of_row.join(numbered.select("_row", "doc_id"), "_row"), "rows")
    least = rows.groupBy("_component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "_component").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.union(known.filter("doc_id is null"))


def _grouped(rows: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    sets = written(rows.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "sets")
    trees, pairs = forest(sets)
    pairs = written(pairs, "candidates")
    texts = texts_of(pairs, docs)
    links = written(confirmed(pairs, texts, width, percent), "links", PAIRS)
    discard(pairs)
    labels = components(links)
    discard(links)
    rest = written(unlinked(trees, sets, labels), "unlinked")  # their texts are there: each had a neighbour
    discard(trees)
    links = written(confirmed_mates(rest, texts, labels, width, percent), "more-links", PAIRS)
    discard(texts, rest)
    of_set = sets.select("set_id", F.col("doc_id").alias("_least")).join(joined(labels, links).withColumnRenamed("id", "_least"), "_least", "left")
    of_set = written(of_set.select("set_id", F.coalesce("component", "_least").alias("_component")), "set-components")
    out = rows.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
