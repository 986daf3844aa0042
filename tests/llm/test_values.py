"""Values of the training-data operators: brute force at hard places, and rows with nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

from manyways.llm import language, likelihood, media, mixing, neardup, neighbours, packing, progressive, quality, repeats, secrets

SCHEMA = "doc_id long, text string, lang string, source string, score double, part int, n_chars long, _text string, copies long, its string, row int"
LONG = ("long text of many words that goes on and on " * 30 + "\n") * 800  # over a megabyte
SAME = "one two three four five six seven eight nine ten"
ROWS = [(1, None, None, "a"), (2, "", "en", "a"), (3, SAME, None, None), (3, SAME, None, None), (4, SAME, "fr", "b"), (5, SAME + " eleven", "de", "b"), (6, LONG, None, "c"), (7, "password = 'abcdef123456'", "en", "b"), (None, "no id but some words", "en", "c"), (None, "no id but other words", "en", "c")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, 0.0, 1, 0, "x", 7, "y", 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_quality_values(spark, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    model = quality.learn(rows, labels)
    out = by_id(quality.quality(rows, model), "held_out", "score", "predicted")
    assert len(out) == len(ROWS) and all(0 <= s <= 1 and p == int(s >= 0.7) and h == (zlib.crc32(str("null" if i is None else i).encode()) % 4 == 2) for i, h, s, p in out)
    same = {i: s for i, _, s, _ in out if i in (3, 4)}
    assert same[3] == same[4] and {s for i, _, s, _ in out if i in (1, 2)} == {model.prior}
    with pytest.raises(ValueError):
        quality.scored(rows, model)
    assert quality.scored(rows, model, "other").columns == [*rows.columns, "other"]
    assert quality.learn(empty, labels) is None and quality.quality(rows, None).filter("score = 0.5").count() == len(ROWS)


def test_quality_votes_by_brute_force():
    rng = np.random.default_rng(0)
    tf, shapes, y = rng.poisson(0.2, (60, quality.BUCKETS)).astype(np.float32), rng.random((60, quality.SHAPES)).astype(np.float32), rng.integers(0, 2, 60)
    m = quality.fit(tf[:50], shapes[:50], y[:50], 20)
    for i, got in enumerate(m.score(tf[50:], shapes[50:]), 50):
        x = np.log1p(tf[i]) * m.idf
        v = np.concatenate((x / np.linalg.norm(x), quality.SHAPE_WEIGHT * shapes[i] / np.sqrt(quality.SHAPES / 8))) @ m.basis
        cosine = [float(v @ w / np.linalg.norm(v)) for w in m.vectors]
        near = sorted(range(50), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        w = [max(cosine[j], 0) ** quality.POWER for j in near]
        assert got == pytest.approx(sum(a * y[j] for a, j in zip(w, near, strict=True)) / sum(w), abs=1e-4)


def test_packing_values(rows, empty):
    out = packing.packed(rows).toPandas()
    assert len(out[out.piece == 0]) == len(ROWS) and out[out.doc_id == 1]["length"].tolist() == [1] == out[out.doc_id == 2]["length"].tolist()
    three = out[out.doc_id == 3]
    assert len(three) == 2 and three["ids_crc32"].nunique() == 1 and out[out.doc_id == 4]["ids_crc32"].iloc[0] == three["ids_crc32"].iloc[0]
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(packing.tokenizer_path()).encode(LONG, add_special_tokens=False).ids, 0], "<u4")
    six = out[out.doc_id == 6].sort_values("start")
    assert six["length"].sum() == len(ids) and [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(six["start"], six["length"], strict=True)] == six["ids_crc32"].tolist()
    assert packing.packed(empty).count() == 0


def test_exact_complements_are_found():
    # 1000 + 1048; 901 + 700 + 447; 800 + 600 + 400 + 248
    p = packing.plan({1000: 2, 1048: 2, 901: 3, 700: 3, 447: 3, 800: 1, 600: 1, 400: 1, 248: 1})
    assert sum(n for _, n in p) == 6 and all(sum(x) == 2048 for x, _ in p)
    index = packing.Complements(np.array([100, 200, 300, 400]), 2048)
    assert index.pairs(500, 2048) == [(400, 100), (300, 200)] and index.pairs(500, 300) == [(300, 200)] and index.largest(600, 2048) == [400, 300, 200]


def test_mixing_values(rows, empty):
    out = by_id(mixing.mix(rows), "source", "size", "copies", "taken")
    assert len(out) == len(ROWS) and all(t == c * n and c <= 2 for _, _, n, c, t in out)
    want = {}
    for i, t, _, s in ROWS:
        want[i, s] = want.get((i, s), 0) + len((t or "").split())
    assert all(n in (0, *{len((t or "").split()) for j, t, _, z in ROWS if (j, z) == (i, s)}) for i, s, n, _, _ in out)
    emitted = mixing.emit(rows)
    assert emitted.columns == rows.columns and emitted.count() == sum(c for *_, c, _ in out)
    assert mixing.mix(empty).count() == 0 == mixing.emit(empty).count()


def test_near_duplicate_values(spark, rows, empty):
    out = by_id(neardup.near_duplicates(rows), "n_shingles", "component_id", "kept")
    words = len({*zip(*(LONG.split()[i:] for i in range(4)), strict=False)})
    assert out == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 7, 3, True), (3, 7, 3, True), (4, 7, 3, False), (5, 8, 3, False), (6, words, 6, True), (7, 1, 7, True), (None, 2, None, True), (None, 2, None, True)], key=str)
    assert neardup.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(1)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 50)) for _ in "ab")
    mixed = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a + " end"), (4, None), (None, a)], "doc_id long, text string")
    assert by_id(neardup.near_duplicates(mixed), "component_id", "kept") == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)], key=str)


def test_near_duplicates_near_the_threshold(spark):
    """2,400 sets in one shallow region, near copies of one text at similarities around 0.8, against all pairs."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(2400):
        t = [*base] if i % 2 else [f"c{x}" for x in rng.integers(0, 10**6, 120)]
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False) if i % 2 else ():
            t[at] = f"x{i}-{at}" if rng.random() < 0.7 else f"y{at}"
        texts.append(" ".join(t))
    sets = [{hash(tuple(t.split()[j : j + 4])) for j in range(117)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    odd = range(1, len(texts), 2)
    for i in odd:
        for j in odd:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_links_of_a_group_are_joined_once(spark, monkeypatch):
    """Components by brute force over a clique, a chain, a star and random links; a clique's links are gone after the first round."""
    rng = np.random.default_rng(5)
    clique = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    chain = [(100 + i, 101 + i) for i in range(30)] + [(200 + i, 299) for i in range(20)]
    loose = [tuple(sorted(x)) for x in rng.integers(300, 400, (60, 2)).tolist() if x[0] != x[1]]
    more = [(0, 100), (1, 39), (110, 210), (500, 501), (39, 500)]

    def least(links):
        parent = {x: x for link in links for x in link}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
        return {x: find(x) for x in parent}

    left, real = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, tag, *a: (t := real(df, tag, *a), left.append(t.count()) if tag == "left-links" else None)[0])
    table = lambda links: real(spark.createDataFrame(links, "a long, b long"), "links")
    got = lambda df: {r.id: r.component for r in df.collect()}
    assert got(neardup.components(table(clique))) == least(clique) and left == [0]
    labels = neardup.components(table(clique + chain + loose))
    assert got(labels) == least(clique + chain + loose)
    assert got(neardup.joined(labels, table(more))) == least(clique + chain + loose + more)


def test_regions_by_definition():
    rng = np.random.default_rng(2)
    rows = sorted((int(r), tuple(int(x) for x in k)) for r, k in zip(rng.integers(0, 3, 300), rng.integers(0, 3, (300, neardup.TAIL)), strict=True))
    own, small = neardup.regions(np.array([k for _, k in rows]), np.array([r for r, _ in rows]))
    for i, (r, k) in enumerate(rows):
        depth = next((d for d in range(neardup.TAIL + 1) if sum(x[0] == r and x[1][:d] == k[:d] for x in rows) <= neardup.NEAR + 1), neardup.TAIL)
        mates = {j for j, x in enumerate(rows) if x[0] == r and x[1][:depth] == k[:depth]}
        assert {*np.flatnonzero(own == own[i]).tolist()} == mates and small[i] == (len(mates) <= neardup.NEAR + 1)


def test_secret_values(rows, empty):
    out = by_id(secrets.find_secrets(rows, secrets.learn(rows)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    none = hashlib.sha256(b"").hexdigest()
    assert [x[1:] for x in out if x[0] in (1, 2)] == [(0, 0, 0, none, "")] * 2
    seven = next(x for x in out if x[0] == 7)
    assert seven[1] == 1 and seven[5] == "assign:0:24" and seven[4] == hashlib.sha256(b"assign:0:24").hexdigest()
    assert len(out) == len(ROWS) and secrets.find_secrets(empty, secrets.learn(empty)).count() == 0
    redacted = secrets.redact(rows, None)
    assert redacted.columns == rows.columns and redacted.filter("doc_id = 7").first().text == "[SECRET]'"


def test_long_credentials_are_learned_whole():
    g = secrets.Grammar(["a1" * 100 + "ZZ99" * 30 + str(i) for i in range(40)], ["plain.word" + "x" * i for i in range(40)])
    assert any("A" in step or "G" in step for step in g.good.step)


def test_language_values(rows, empty):
    out = by_id(language.identified(rows, language.train(*language.sample(rows), steps=3)), "held_out", "lang_pred", "score")
    assert len(out) == len(ROWS) and [x[2:] for x in out if x[0] in (1, 2)] == [("und", 0.0)] * 2
    assert all(0 <= s <= 1 and p in ("en", "fr", "de", "und") and h == (zlib.crc32(str("null" if i is None else i).encode()) % 5 == 0) for i, h, p, s in out)
    assert language.train(*language.sample(empty)) is None and language.identified(rows, None).filter("lang_pred = 'und'").count() == len(ROWS)


def test_every_language_is_trained(monkeypatch):
    monkeypatch.setattr(language, "PER_NAME", 60)
    names = [f"l{i:03}" for i in range(150)]
    seen = []
    real = language.Model.gradients
    monkeypatch.setattr(language.Model, "gradients", lambda self, x, y: (seen.extend(y.tolist()), real(self, x, y))[1])
    language.train([bytes([40 + i]) * 60 for i in range(150)], names, steps=1)
    counts = np.bincount(seen, minlength=150)
    assert len(counts) == 150 and counts.min() >= 59


def test_likelihood_values(rows, empty):
    out = by_id(likelihood.likelihoods(rows, likelihood.learn(rows, 5)), "n_words", "log_likelihood", "mean_log")
    words = {i: len((t or "").split()) for i, t, _, _ in ROWS if i}
    assert len(out) == len(ROWS) and all(n == words[i] for i, n, _, _ in out if i) and all(x <= 0 and m == pytest.approx(x / max(n, 1)) for _, n, x, m in out)
    assert [x[2] for x in out if x[0] in (1, 2)] == [0.0, 0.0] and len({round(x[2], 6) for x in out if x[0] in (3, 4)}) == 1
    assert likelihood.likelihoods(empty, likelihood.learn(empty, 1)).count() == 0


def test_likelihood_gradients_by_differences():
    rng = np.random.default_rng(3)
    net = likelihood.Network()
    net.e, net.w, net.b, net.v, net.c, net.g, net.x, net.d = (p.astype(np.float64) for p in net.parameters())
    ctx, codes = rng.integers(0, 60, (40, 2 * likelihood.SIDE)), rng.integers(0, 300, 40)
    _, g = net.gradients(ctx, codes)
    for p, d in zip(net.parameters(), g, strict=True):
        i = np.unravel_index(np.argmax(abs(d)), d.shape)
        old = p[i]
        p[i] = old + 1e-4
        up = net.gradients(ctx, codes)[0]
        p[i] = old - 1e-4
        down = net.gradients(ctx, codes)[0]
        p[i] = old
        assert d[i] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-7)
    loss = net.gradients(ctx, codes)[0]
    assert -net.logs(ctx, codes).mean() == pytest.approx(loss, rel=1e-6)


def test_media_values(spark, rows, empty):
    out = {r.doc_id: r for r in media.stored(rows, keep_media=True).collect()}
    for i, t, _, _ in ROWS:
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert out[3].feature == out[4].feature and out[1].media == out[2].media
    files = spark.createDataFrame([(1, bytearray(out[3].media), 5), (2, bytearray(b"not a picture"), 5), (3, None, 5)], "k int, media binary, height int")
    got = {r.k: r for r in media.images(files).collect()}
    tensor = progressive.pixels(progressive.decode_coefficients([bytes(out[3].media)])[0])
    assert (got[1].height, got[1].width, bytes(got[1].rgb)) == (*tensor.shape[:2], tensor.tobytes()) and tensor.shape[2] == 3 and media.feature(tensor) == out[3].feature
    assert got[2].rgb is None is got[3].rgb and media.stored(empty).count() == 0


def test_neighbour_values(spark):
    data = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (40, [0.0, 2.0]), (41, [0.0, -1.0]), (42, None), (43, [0.0, 0.0]), (44, [float("nan"), 1.0]), (None, [5.0, 5.0]), (60, [1e200, 1e-200]), (61, [1e200, 0.0]), (80, [1.0, 2.0, 3.0])]
    got = neighbours.nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, key string, dim int"))
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by[20]) == [(1, 60, 1e200), (2, 61, 1e200), (3, 21, 1.0), (4, 22, 1.0), (5, 40, 0.0), (6, 41, 0.0)]
    assert [x[1] for x in sorted(by[40])] == [60, 20, 21, 22, 61, 41] and 80 not in by and {*by} == {20, 40, 60}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty).count() == 0


def brute(rows):
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if (w := b[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone]
        want.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize("hot", [0, 1, 256])
def test_repeats_across_pieces_and_hot_grams(spark, hot, monkeypatch):
    rng = np.random.default_rng(4)
    piece = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    common, big = piece(130), piece(2 * repeats.CHUNK)
    rows = [(i, piece(int(rng.integers(0, 90))) + common[int(rng.integers(0, 20)) :] + piece(int(rng.integers(0, 90)))) for i in range(60)]
    rows += [(100, big), (101, big[repeats.CHUNK - 300 : repeats.CHUNK + 500] + "!"), (102, piece(50) + big[100:900]), (103, None), (104, "\0" * 250), (105, "x" + "\0" * 120), (None, common), (None, common + "z"), (106, rows[0][1]), (106, rows[0][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    got = by_id(repeats.removed(d, part_bytes=4000, bucket_bytes=200_000, hot=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute(rows)


def test_pipeline_stages_on_odd_rows(spark, rows, empty, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for d in (rows, empty):
        docs = d.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in p.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "best-fit packing" or out.columns == docs.columns
        assert p.classify(spark, docs, str(tmp_path)).count() == docs.count()
        assert p.deduplicate(spark, docs, str(tmp_path)).count() == (7 if d is rows else 0)  # 3 twice, 4 and 5 are one group
        assert p.clean(spark, docs, str(tmp_path)).filter("text rlike 'abcdef123456'").count() == 0
