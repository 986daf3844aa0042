"""Alignment of two tokenizers: where their tokens end together, which of their ids overlap, and how many documents hold each such pair."""

from __future__ import annotations

import array
import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import table, trimmed, written

#: A pair of ids is one number: the A id times SIDES plus the B id.
SIDES = 1 << 15
#: Documents are taken together up to so many, or so many characters.
PIECE_DOCS = 4096
PIECE_CHARS = 2_000_000
#: A ids are dealt into so many buckets; a bucket's postings are dealt once more where all buckets together hold more than TASK bytes each.
BUCKETS = 1024
TASK = 32_000_000
#: So many chunks a worker remembers, none longer than LONGEST characters.
KNOWN = 500_000
LONGEST = 64
FIELDS = "n_a int, n_b int, n_groups int, n_links int, groups_sha256 string"


class Aligner:
    """Both tokenizers over chunks of texts. A chunk begins at a space behind a character that is no white space. No token of either
    tokenizer crosses such a place, and what a chunk becomes doesn't depend on the others: A's pre-tokens take a space only in front,
    B has no piece with a space behind another character. So each chunk is encoded and aligned once, and texts add up their chunks'."""

    def __init__(self):
        import public_tokenizers as public
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True  # their strings are plain text
        with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})  # the same vocabulary; its classes of characters are the same up to U+024F at least
        self.beyond = re.compile("[^\x00-\u024f]").search
        self.b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in visible)}  # the byte-level alphabet
        self.a_bytes = [bytes(byte[c] for c in self.a.id_to_token(i)) if all(c in byte for c in self.a.id_to_token(i)) else b"" for i in range(self.a.get_vocab_size())]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        self.names = [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;"]
        self.apart, self.spaced = re.compile(r"(?<=\S)(?= )").split, re.compile(r"\s ").search
        self.index: dict[str, int] = {}
        self.sizes = array.array("i")  # of each chunk: A tokens, B tokens, groups, links; -1 where bytes differ
        self.groups: list[str] = []
        self.pair_at, self.pair = array.array("q", [0]), array.array("i")

    def chunks(self, text: str) -> list[str]:
        """The chunks of space + text, each without its first space."""
        if text[0] != " " and not self.spaced(text):
            return text.split(" ")
        return [c[1:] for c in self.apart(" " + text)]

    def learn(self, words: list[str]) -> None:
        """Appends chunks: ids of both sides, their groups and links, all found at once over the chunks' bytes side by side."""
        plain, other, beyond = self.plain._core_bpe.encode_ordinary, self.a.encode, self.beyond
        a = [other(" " + w, add_special_tokens=False).ids if beyond(w) else plain(" " + w) for w in words]
        b = [ids or [self.b.piece_to_id("▁")] for ids in self.b.encode(words, num_threads=1)]  # which puts the first space there, unless that is all
        nb = np.array([*map(len, b)])
        flat = np.fromiter(chain.from_iterable(b), np.int64)
        ends = np.concatenate(([0], np.cumsum(self.b_size[flat])))[np.concatenate(([0], np.cumsum(nb)))]
        for i in np.flatnonzero(np.diff(ends) != [len(w.encode()) + 1 for w in words]).tolist():  # A's tokens always are the text's bytes; B loses U+2581's
            a[i], b[i] = [], []
        na, nb = np.array([*map(len, a)]), np.array([*map(len, b)])
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        ea, eb = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(ea, eb, assume_unique=True)
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        seq = np.empty(len(a) + len(b), np.int64)
        seq[np.arange(len(a)) + np.searchsorted(gb, ga)] = a * 3 + last(ga)
        seq[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = b * 3 + 2 * last(gb)
        first, beyond = np.searchsorted(eb, ea - self.a_size[a], "right"), np.searchsorted(eb - self.b_size[b], ea)
        n = beyond - first
        at = np.cumsum(n)
        pair = np.repeat(a * SIDES, n) + b[np.arange(len(b) and n.sum()) - np.repeat(at - n - first, n)]
        ends_a = np.cumsum(na)
        link_end = np.concatenate(([0], at))[ends_a]
        group_end = np.concatenate(([0], ga + 1))[ends_a]
        before = lambda x: np.diff(x, prepend=0)
        sizes = np.stack((na, nb, before(group_end), before(link_end)), axis=1)
        sizes[na == 0] = -1
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        names, ids, ends = self.names, seq.tolist(), np.cumsum(na + nb).tolist()
        self.groups += ["".join([names[x] for x in ids[begin:end]]) for begin, end in zip([0, *ends], ends, strict=False)]
        self.pair_at.frombytes((self.pair_at[-1] + link_end).astype(np.int64).tobytes())
        self.pair.frombytes(pair.astype(np.int32).tobytes())

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: sizes (A tokens, B tokens, groups, links; zeros without tokens) and the digest of its groups. And the links
        added up: (pair, text, times) in that order."""
        chunks = [self.chunks(t) if t else [] for t in texts]
        count = np.array([*map(len, chunks)], np.int64)
        words = [*chain.from_iterable(chunks)]
        found = [*map(self.index.get, words)]
        base = len(self.index)
        new = sorted({w for w, i in zip(words, found, strict=True) if i is None}, key=len)
        if new:
            fresh = dict(zip(new, range(base, base + len(new)), strict=True))
            self.learn(new)
            found = [fresh[w] if i is None else i for w, i in zip(words, found, strict=True)]
        which = np.array(found, np.int64)
        sizes, pair_at = np.frombuffer(self.sizes, np.int32).reshape(-1, 4), np.frombuffer(self.pair_at, np.int64)
        ends = np.cumsum(count)
        per_text = lambda x: np.diff(np.concatenate((np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0, dtype=np.int64)))[np.append(0, ends)], axis=0)
        total = per_text(sizes[which])
        bad = per_text((sizes[which, :1] < 0).astype(np.int64))[:, 0] > 0
        total[bad] = 0
        groups, digests = self.groups, []
        for i, (begin, end) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
            digests.append("" if bad[i] or begin == end else hashlib.sha256("".join([groups[x] for x in found[begin:end]])[:-1].encode()).hexdigest())
        which = which[~np.repeat(bad, count)]
        n = pair_at[which + 1] - pair_at[which]
        at = np.cumsum(n)
        pairs = np.frombuffer(self.pair, np.int32)[np.repeat(pair_at[which] - (at - n), n) + np.arange(n.sum())].astype(np.int64)
        key = np.sort(pairs * len(texts) + np.repeat(np.arange(len(texts)), total[:, 3]))
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times = np.diff(np.append(begin, len(key)))
        key = key[begin]
        del sizes, pair_at  # so that the arrays can grow
        self._remember(new, base)
        return total, digests, key // len(texts), key % len(texts), times

    def _remember(self, new: list[str], base: int) -> None:
        """Keeps short new chunks while there is room; what was appended for the others goes."""
        keep = min(sum(len(w) <= LONGEST for w in new), max(KNOWN - base, 0))  # new is in order of length
        self.index.update(zip(new[:keep], range(base, base + keep), strict=True))
        if keep < len(new):
            n = base + keep
            del self.pair[self.pair_at[n] :], self.pair_at[n + 1 :], self.sizes[4 * n :], self.groups[n:]


_aligner: list[Aligner] = []


def aligner() -> Aligner:
    if not _aligner:
        _aligner.append(Aligner())
    return _aligner[0]


def _pieces(texts: list[str]):
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and to - at < PIECE_DOCS and (to == at or chars + len(texts[to]) <= PIECE_CHARS):
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to


def postings(docs: DataFrame) -> DataFrame:
    """Two kinds of rows. Of each document: piece and place in it, doc_id, sizes and digest. Of each piece and bucket of A ids: the pairs
    in order, how many of the piece's documents hold each, and those documents' places and how often each has the pair."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"piece long, place int, doc_id {kind}, {FIELDS}, bucket int, pair array<int>, held array<int>, at binary, times binary"

    def each(batches):
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in _pieces(texts):
                total, digests, pair, place, times = aligner().align(texts[begin:end])
                n = end - begin
                none = lambda t: pa.nulls(n, t)
                sizes = [pa.array(total[:, i].astype(np.int32)) for i in range(4)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), pa.array(np.arange(n, dtype=np.int32)), batch.column(0).slice(begin, n), *sizes, pa.array(digests, pa.string()), none(pa.int32()), none(ints), none(ints), none(pa.binary()), none(pa.binary())], out.names)
                deal = bucket_of(pair)
                order = np.argsort(deal, kind="stable")
                pair, place, times = pair[order], place[order], times[order]
                found, cuts = np.unique(deal[order], return_index=True)
                rows: list[list] = [[], [], [], []]
                for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                    p, counts = np.unique(pair[s:e], return_counts=True)
                    wide = times[s:e].max() > 255
                    for row, x in zip(rows, (p.astype(np.int32), counts.astype(np.int32), place[s:e].astype(np.uint16).tobytes(), times[s:e].astype(np.uint32 if wide else np.uint8).tobytes()), strict=True):
                        row.append(x)
                n = len(found)
                empty = [none(f.type) for f in list(out)[1:8]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), *empty, pa.array(found.astype(np.int32)), pa.array(rows[0], ints), pa.array(rows[1], ints), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], out.names)
                piece += 1

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select("doc_id", "text").mapInArrow(trimmed(each), schema)


def bucket_of(pair: np.ndarray) -> np.ndarray:
    """The bucket of a pair: that of its A id alone."""
    return ((pair // SIDES) * 2654435761 % (1 << 32)) * BUCKETS >> 32


def contributions(batches):
    """Over a sorted stream: first the counts of all pairs of each share of a bucket, then its postings. Counts and each A id's highest
    are found here; of each document, packed by piece: how many links have its A id's highest count, and the sum of the links' counts."""
    counts: dict[tuple[int, int], list] = {}
    ready: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def looked_up(key: tuple[int, int]):
        if key not in ready:
            pair, n = (np.concatenate(x) for x in zip(*counts.pop(key), strict=True))
            order = np.argsort(pair)
            pair, n = pair[order], n[order]
            a = pair // SIDES
            begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
            most = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(a))))
            ready[key] = pair, n, n == most
        return ready[key]

    def summed(piece: int, found: list) -> pa.RecordBatch:
        place, best, total = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        place, best, total = place[order], best[order], total[order]
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        columns = place[begin].astype(np.uint16), np.add.reduceat(best, begin), np.add.reduceat(total, begin)
        return pa.RecordBatch.from_arrays([pa.array([piece]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["piece", "at", "best", "total"])

    piece, found = None, []
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        key = [*zip(columns["bucket"].to_pylist(), columns["salt"].to_pylist(), strict=True)]
        of = columns["piece"].to_numpy(zero_copy_only=False)
        count = np.flatnonzero(of < 0)
        if len(count):
            pair, n = columns["id"].to_numpy(zero_copy_only=False)[count].astype(np.int64), columns["n"].to_numpy(zero_copy_only=False)[count].astype(np.int64)
            codes = np.array([key[i][0] * (1 << 32) + key[i][1] for i in count])
            for c in np.unique(codes).tolist():
                counts.setdefault((c >> 32, c & 0xFFFFFFFF), []).append((pair[codes == c], n[codes == c]))
        for i in np.flatnonzero(of >= 0).tolist():
            if piece != of[i]:
                if found:
                    yield summed(piece, found)
                piece, found = int(of[i]), []
            pair, n, best = looked_up(key[i])
            at = np.searchsorted(pair, columns["pair"][i].values.to_numpy().astype(np.int64))
            held = columns["held"][i].values.to_numpy()
            place, times = np.frombuffer(columns["at"][i].as_py(), np.uint16), columns["times"][i].as_py()
            times = np.frombuffer(times, np.uint8 if len(times) == len(place) else np.uint32).astype(np.int64)
            found.append((place.astype(np.int64), np.repeat(best[at], held) * times, np.repeat(n[at], held) * times))
    if found:
        yield summed(piece, found)


def totals(batches):
    """Adds up contributions() that come sorted by piece: piece, place, n_best, count_sum."""
    piece, best, total = None, np.zeros(PIECE_DOCS, np.int64), np.zeros(PIECE_DOCS, np.int64)

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(at), piece), at.astype(np.int32), best[at], total[at]))], ["piece", "place", "n_best", "count_sum"])

    for batch in batches:
        for p, at, b, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if p != piece:
                if piece is not None:
                    yield done()
                piece = p
                best[:], total[:] = 0, 0
            at = np.frombuffer(at, np.uint16)
            best[at] += np.frombuffer(b, np.int64)
            total[at] += np.frombuffer(t, np.int64)
    if piece is not None:
        yield done()


def aligned(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Each document's links are added up by pair of ids and dealt by their A id, packed by piece of some thousand documents. How many
    documents hold a pair is summed up beforehand and goes ahead of the postings in a sorted stream. Where a bucket has more postings
    than a task should read, they are dealt once more by piece, and each share gets the bucket's counts; so no id, however frequent,
    is one task's, and a task holds the counts of its buckets and one piece's sums.
    Null or empty texts, and those that B's tokens don't give back byte by byte (the character U+2581), have zeros and ''. Equal rows
    give equal rows, each counted as a document; an empty table gives none; other columns play no part. A text is held whole by one task.
    """
    rows = written(postings(docs), "postings", records=2048)
    blocks = rows.filter("bucket is not null").select("piece", "bucket", "pair", "held", "at", "times")
    size = blocks.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    salts = 1 + size // (BUCKETS * TASK)
    counts = blocks.select("bucket", F.explode(F.arrays_zip("pair", "held")).alias("x")).groupBy(F.col("x.pair").alias("id"), "bucket").agg(F.sum("x.held").alias("n"))
    ahead = counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("piece"), "id", "n")
    dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int")).unionByName(ahead, allowMissingColumns=True)
    stream = dealt.repartition("bucket", "salt").sortWithinPartitions("piece", "bucket")
    parts = stream.mapInArrow(trimmed(contributions), "piece long, at binary, best binary, total binary")
    sums = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(trimmed(totals), "piece long, place int, n_best long, count_sum long")
    done = written(sums, "sums", records=2048)
    long = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    own = rows.filter("place is not null").select("piece", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own.join(done, ["piece", "place"], "left").select("doc_id", *map(long, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
