"""Results that depend on the text alone, whatever stands beside it, and grammars of planted credential formats."""

import base64
import random
import string

import numpy as np
import pytest

from manyways.llm import language, likelihood, secrets

R = random.Random(7)


def bytes_of(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def small_model():
    words = {"en": "the house and of tree in river stone", "fr": "la maison été où forêt dans rivière", "de": "das Haus über Baum und Fluss straße"}
    labels = [k for k in words for _ in range(40)]
    return language.train([" ".join(R.choices(words[k].split(), k=30)).encode() for k in labels], labels, steps=30)


def test_language_alone_and_in_any_block():
    m = small_model()
    texts = [("the house " * n + "été" * k).encode()[: 3 + 7 * n] for n in range(1, 40) for k in range(3)] + [b"", b"x"]
    whole = language.pooled(m, *bytes_of(texts))
    alone = np.concatenate([language.pooled(m, *bytes_of([t])) if t else np.zeros((1, len(m.names))) for t in texts])
    assert np.abs(whole - alone).max() < 1e-6 and (whole[:-2].argmax(axis=1) == alone[:-2].argmax(axis=1)).all()


def test_language_by_a_loop_over_positions():
    m = small_model()
    text = ("the house été " * 20).encode()[:217]

    def states(x, d):
        n, h, out = m.u[d].shape[0], 0.0, {}
        h = np.zeros(n)
        for i in range(len(x)) if d == 0 else reversed(range(len(x))):
            a, b = m.w[d][x[i]], h @ m.u[d]
            z, r = (1 / (1 + np.exp(-(a[k] + b[k]))) for k in (slice(0, n), slice(n, 2 * n)))
            h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
            out[i] = h
        return out

    total = np.zeros(len(m.names))
    for at in range(0, len(text), language.WINDOW):
        x = text[at : at + language.WINDOW]
        f, g = states(x, 0), states(x, 1)
        for i in range(len(x)):
            e = np.exp(np.concatenate((f[i], g[i])) @ m.v + m.c)
            total += e / e.sum()
    assert language.pooled(m, *bytes_of([text]))[0] == pytest.approx(total / len(text), abs=1e-6)


def test_likelihood_does_not_depend_on_layout(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(R.choices(words, k=R.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "one"), (503, "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    values = lambda x: {r.doc_id: (r.n_words, r.log_likelihood) for r in likelihood.likelihoods(x, likelihood.learn(x, 40, 2000)).collect()}
    one, other = values(d), values(d.repartition(5, "text"))
    assert one == other and one[502] == one[503] and one[500] == one[501] == (0, 0.0)


def test_likelihood_learns_from_every_word(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(R.choices(words, k=k)) for k in (0, 1, 63, 64, 65, 200, 1000)] + [None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab, _, _ = likelihood.learn(d, 1)
    found, side, size = [], likelihood.SIDE, likelihood.SEGMENT
    for r in likelihood.dealt(d, vocab, 5).collect():
        for x in np.frombuffer(r.codes, np.int16).reshape(-1, size + 2 * side).tolist():
            found += [tuple(x[k - side : k + side + 1]) for k in range(side, size + side) if x[k] != likelihood.PAD]
    want = []
    for text in texts:
        codes = [int(vocab.encode(likelihood.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0])[0]) for w in (text or "").split()]
        codes = [likelihood.PAD] * side + codes + [likelihood.PAD] * side
        want += [tuple(codes[k - side : k + side + 1]) for k in range(side, len(codes) - side)]
    assert len(want) == 1393 and sorted(found) == sorted(want)


def test_words_score_alike_in_any_block():
    net, rng = likelihood.Network(), np.random.default_rng(1)
    ctx, codes = rng.integers(0, likelihood.PAD + 1, (5000, 4)), rng.integers(0, likelihood.PAD, 5000)
    order = rng.permutation(5000)
    logs = lambda c, y: np.concatenate([net.logs(a, b)[:n] for a, b, n in likelihood.blocks(c, y, likelihood.TOGETHER)])
    assert (logs(ctx[order], codes[order]) == logs(ctx, codes)[order]).all() and (logs(ctx[:9], codes[:9]) == logs(ctx, codes)[:9]).all()
    sums = lambda c, y: (likelihood.gradient_sums(net, c, y, into := [np.zeros(x.shape, np.int64) for x in net.parameters()]), into)[1]
    a, b, parts = sums(ctx, codes), sums(ctx[order], codes[order]), [sums(ctx[k::3], codes[k::3]) for k in range(3)]
    assert all((x == y).all() and (x == sum(p)).all() for x, y, *p in zip(a, b, *parts, strict=True))
    for got, want in zip(a, net.gradients(ctx, codes)[1], strict=True):
        assert got / (likelihood.UNIT**2 * 5000) == pytest.approx(want, abs=5e-6)


def test_likelihood_is_the_sum_over_words_by_a_loop(spark):
    rows = [(1, "a b c a b c d e a"), (2, "a"), (3, "zz unknown words here"), *((10 + i, "a b c d e f " * 5) for i in range(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    vocab, net, shares = likelihood.learn(d, 60, 500)
    known = {r.word: r.log_share for r in shares.collect()}
    least = min(known.values(), default=0.0)
    got = {r.doc_id: r for r in likelihood.likelihoods(d, (vocab, net, shares)).collect()}
    for i, text in rows[:4]:
        h = [likelihood.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in text.split()]
        codes = [int(vocab.encode(np.array([x]))[0]) for x in h]
        total = 0.0
        for at, c in enumerate(codes):
            ctx = [codes[k] if 0 <= k < len(codes) else likelihood.PAD for k in (at - 2, at - 1, at + 1, at + 2)]
            x = np.tanh(np.concatenate([net.e[k] for k in ctx]) @ net.w + net.b)
            first, second = x @ net.v + net.c, np.tanh(x + net.g[c // 64]) @ net.x + net.d[c // 64]
            total += sum(z[k] - np.log(np.exp(z.astype(float)).sum()) for z, k in ((first, c // 64), (second, c % 64)))
            total += known.get(int(h[at].astype(np.int64)), least) if c >= likelihood.COMMON else 0.0
        assert got[i].n_words == len(codes) and got[i].log_likelihood == pytest.approx(total, rel=1e-4)


FORMATS = {
    "base64": lambda: base64.b64encode(R.randbytes(30)).decode()[:39] + "=",
    "access": lambda: "AKIA" + "".join(R.choices(string.ascii_uppercase + string.digits, k=16)),
    "token": lambda: "tok_live_" + "".join(R.choices("0123456789abcdef", k=24)) + "".join(R.choices(string.digits, k=6)),
    "hex": lambda: "".join(R.choices("0123456789abcdef", k=40)),
}


def test_grammars_of_planted_formats():
    syllables = ["ba", "ther", "in", "ou", "cra", "tion", "ze", "mel", "pos", "ard"]
    word = lambda: "".join(R.choices(syllables, k=R.randint(4, 7)))
    other = lambda: R.choice([word, lambda: word() + "." + word(), lambda: f"{word()}-{R.randint(1, 99)}", lambda: "/".join(word() for _ in range(3)), lambda: f"20{R.randint(10, 30)}-{R.randint(10, 12)}-{R.randint(10, 28)}", lambda: str(R.randint(10**8, 10**12))])()
    good = {"assign": [FORMATS[k]() for k in ("base64", "token") for _ in range(100)], "access": [FORMATS["access"]() for _ in range(100)], "hex": [FORMATS["hex"]() for _ in range(100)]}
    g = secrets.Grammar(good, [other() for _ in range(600)])
    assert set(g.good) == {"assign", "access", "hex"} and g.good["assign"].states > 5 and g.good["access"].states > 1
    for make in FORMATS.values():
        assert sum(g.finds(make()) for _ in range(200)) >= 180
    assert sum(g.finds(other()) for _ in range(1000)) <= 20
    assert g.score(FORMATS["token"]()) > g.score("tok_live_" + word())
    few = secrets.Grammar({"assign": [], "access": [], "hex": good["hex"][:11]}, [other() for _ in range(50)])
    assert sum(few.finds(FORMATS["hex"]()) for _ in range(100)) >= 90 and not any(few.finds(other()) for _ in range(200))
