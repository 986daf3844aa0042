"""Token counts, tokenizer alignment and divergence audit against their libraries, plain loops and exact fractions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyways.llm import alignment, counts, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, piece int, term string, value string"
WORDS = "the of and Über straße data's 12,345 tokens!! \tnew\nline foo_bar <|endoftext|> <s> 漢字 😀 \x00 it's WE'LL".split(" ")


def texts(seed, n):
    r = random.Random(seed)
    odd = "ab  \n\t▁é漢\0'<s>.0😀\xa0\x85" + "e t 'll"
    return ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(n)] + [" ".join(r.choices(WORDS, k=r.randint(1, 40))) for _ in range(n)]


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b ", "x▁y", "▁", "same text", "same text", "long " * 50_000, "unbroken" * 20_000]


def rows(spark, some):
    return spark.createDataFrame([(i if i != 5 else None, t, "en", "a", 1, 2, "x", "y") for i, t in enumerate(some)], SCHEMA)


def test_proof_of_whole_tokens():
    proof = counts.proved(counts.model_path("piece_bpe_32k.model"))
    c = counts.counter(counts.model_path("piece_bpe_32k.model"), proof)
    assert proof.cuts and len(proof.whole) > 10_000
    assert all(c.library.encode(w) == [c.library.piece_to_id("▁" + w)] for w in proof.whole if w)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_the_library(name):
    path = counts.model_path(name)
    c = counts.counter(path, counts.proved(path))
    plain = (lambda t: len(c.library.encode(t))) if name.endswith("model") else (lambda t: len(c.library.encode(t, add_special_tokens=False).ids))
    for t in [*texts(1, 1500), *(t for t in ODD if t)]:
        assert c.count(t) == plain(t), t[:80]


def test_memory_of_counts_is_bounded():
    path = counts.model_path("piece_bpe_32k.model")
    c = counts.PieceCounter(path, counts.proved(path))
    c.known.room, before = 3, len(c.known)
    assert all(c.count(f"qzx{i}wv ykj{i}") == len(c.library.encode(f"qzx{i}wv ykj{i}")) for i in range(50))
    assert len(c.known) == before + 3


def test_count_query_on_odd_rows(spark):
    out = counts.token_counts(rows(spark, ODD)).collect()
    c = counts.counter(counts.model_path("piece_bpe_32k.model"), counts.proved(counts.model_path("piece_bpe_32k.model")))
    want = [(i if i != 5 else None, len((t or "").encode()), len(c.library.encode(t or ""))) for i, t in enumerate(ODD)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out) and sum(r.over_limit for r in out) == 2
    assert counts.token_counts(rows(spark, ODD).limit(0)).count() == 0


def plain_alignment(t):
    """Sizes, groups and links of one text by loops over both tokenizers' whole output; None without tokens."""
    x = alignment.aligner()
    if not t:
        return None
    a, b = x.a.encode(" " + t, add_special_tokens=False).ids, x.b.encode(t)
    if any(b"".join(names[i] for i in ids) != (" " + t).encode() for ids, names in ((a, x.a_bytes), (b, x.b_bytes))):
        return None
    ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for ids, names in ((a, x.a_bytes), (b, x.b_bytes))]
    groups, links, i, j = [], [], 0, 0
    for e in sorted({*ends[0]} & {*ends[1]}):
        i0, j0 = i, j
        while i < len(a) and ends[0][i] <= e:
            i += 1
        while j < len(b) and ends[1][j] <= e:
            j += 1
        groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        for p in range(i0, i):
            for q in range(j0, j):
                if (ends[0][p - 1] if p else 0) < ends[1][q] and (ends[1][q - 1] if q else 0) < ends[0][p]:
                    links.append((a[p], b[q]))
    return len(a), len(b), len(groups), links, ";".join(groups)


@pytest.mark.parametrize("room", [500_000, 20])
def test_alignment_by_loops(room, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", room)
    x = alignment.Aligner()
    some = [*texts(2, 600), *(t or "" for t in ODD[:12])]
    for at in range(0, len(some), 200):
        part = some[at : at + 200]
        total, digests, pair, place, times = x.align(part)
        held = collections.defaultdict(dict)
        for p, d, n in zip(pair.tolist(), place.tolist(), times.tolist(), strict=True):
            held[d][divmod(p, alignment.SIDES)] = n
        for i, t in enumerate(part):
            want = plain_alignment(t) or (0, 0, 0, [], None)
            assert total[i].tolist() == [*want[:3], len(want[3])] and held[i] == collections.Counter(want[3]), t
            assert digests[i] == ("" if want[4] is None else hashlib.sha256(want[4].encode()).hexdigest())


@pytest.mark.parametrize("task", [32_000_000, 40])
def test_alignment_query_by_brute_force(spark, task, monkeypatch):
    """Also where buckets are dealt once more."""
    monkeypatch.setattr(alignment, "TASK", task)
    monkeypatch.setattr(alignment, "BUCKETS", 8 if task < 100 else alignment.BUCKETS)
    monkeypatch.setattr(alignment, "PIECE_DOCS", 7)
    some = [*ODD[:12], *texts(3, 40), *texts(3, 10)]
    df = rows(spark, some).repartition(5)
    plain = [plain_alignment(t) for t in some]
    held = collections.Counter(x for p in plain if p for x in {*p[3]})
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    want = []
    for i, p in enumerate(plain):
        key = i if i != 5 else None
        want.append((key, *p[:3], len(p[3]), sum(held[x] == most[x[0]] for x in p[3]), sum(held[x] for x in p[3]), hashlib.sha256(p[4].encode()).hexdigest()) if p else (key, 0, 0, 0, 0, 0, 0, ""))
    assert sorted(map(tuple, alignment.aligned(df).collect()), key=str) == sorted(want, key=str)
    assert alignment.aligned(df.limit(0)).count() == 0


def plain_audit(data, least, top):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))) for text, lang, source in data]
    out = []
    for lang in {x for x, _, _ in words}:
        own = [(s, w) for x, s, w in words if x == lang]
        docs = collections.Counter(t for _, w in own for t in {*w})
        kept = [t for t, n in docs.items() if n >= least]
        by = {s: collections.Counter() for s, _ in own}
        for s, w in own:
            by[s].update(t for t in w if docs[t] >= least)
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        everywhere = sum(by.values(), collections.Counter())
        for s, c in by.items():
            pair = [(o, sum(abs(share(c, t) - share(d, t)) for t in kept)) for o, d in by.items() if o != s]
            term = [(t, share(c, t) - share(everywhere, t)) for t in c if c[t] and share(c, t) > share(everywhere, t)]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1024, 64), (3, 2)])
def test_audit_in_exact_arithmetic(spark, blocks):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("The", "élan", "ß", "x", "Zed") for b in ("", "s", "ing", "漢")]
    data = [(" ".join(r.choices(vocabulary[: r.randint(2, 20)], k=r.randint(0, 30))) + "_3-" * r.randint(0, 1), r.choice(["en", "fr", None]), r.choice(["a", "b", "c", "ä", None, "d", "e"])) for _ in range(160)]
    data += [(None, "en", "empty"), ("", "xx", "a"), ("one", "xx", "b"), ("rare", "yy", "only")] + [data[0]] * 5 + [("x " * 30_000, "en", "long")]
    df = spark.createDataFrame([(i, t, x, s, 1, 2, "x", "y") for i, (t, x, s) in enumerate(data)], SCHEMA)
    got = sorted(map(tuple, divergence.audit(df, 4, 5, chunk_terms=blocks[0], block_groups=blocks[1]).collect()))
    assert got == plain_audit(data, 4, 5)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_double_precision(spark):
    n, total, v = 123_456_789_012_345_678, 987_654_321_098_765_432, 77_777_777
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
