"""Files of a corpus: discovery, lines, digests, caches, locks, sinks."""

import pytest
from pyspark.sql import functions as F

from manyways.sources import corpus
from manyways.streaming import incremental


@pytest.fixture
def root(tmp_path):
    for path, size in (("arm1/run1/main.py", 500), ("arm1/run1/other.py", 300), ("arm1/run1/tiny.py", 10), ("run2/main.py", 400)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("a\rb\n" + "x" * (size - 4))
    (tmp_path / "pointer.py").write_text("version https://git-lfs.github.com/spec/v1")
    return str(tmp_path)


def test_discovery(spark, root):
    got = {(r.run, r.arm, r.role, r.length) for r in corpus.discover(spark, root, r"\.(py)$", r"(run\d)/", r"(arm\d)/").collect()}
    assert got == {("run1", "arm1", "py", 500), ("run1", "arm1", "py_secondary", 300), ("run2", "unknown", "py", 400)}


def test_lines_break_at_line_feeds_only(spark, root):
    got = [r.content for r in corpus.lines(spark, f"{root}/run2", "*.py").orderBy("line").collect()]
    assert got[0] == "a\rb" and len(got) == 2


def test_placeholders_and_digest(spark, root):
    assert [r.path.rsplit("/", 1)[-1] for r in corpus.placeholders(spark, root).collect()] == ["pointer.py"]
    found = corpus.checksums(spark, root, "*.py")
    digest = corpus.layer_digest(found).first().digest
    assert len(digest) == 64 and corpus.layer_digest(found.orderBy(F.desc("path"))).first().digest == digest
    assert [corpus.lock_state(*x) for x in ((None, None), (None, "a"), ("a", "a"), ("b", "a"))] == ["absent", "unlocked", "locked", "STALE"]


def test_documents_must_be_there(spark, tmp_path):
    (tmp_path / "t1.json").write_text('{"n": 3}')
    assert corpus.document(spark, str(tmp_path), "t1", "n int").first().n == 3
    with pytest.raises(Exception, match="(?i)path"):
        corpus.document(spark, str(tmp_path), "t2", "n int").count()


def test_cache(spark):
    d = spark.createDataFrame([("h", "m", 1, "x")], "h string, m string, a int, b string")
    one = d.select(corpus.cache_key(F.col("h"), F.col("m"), {"a": F.col("a"), "b": F.col("b")}, {}).alias("k")).first().k
    two = d.select(corpus.cache_key(F.col("h"), F.col("m"), {"b": F.col("b"), "a": F.col("a")}, {}).alias("k")).first().k
    assert one == two and len(one) == 64
    cache = spark.createDataFrame([("k1", "p1", "m", "h1", "x", 0.5), ("k2", "p1", "m", "h0", "x", 0.25), ("k3", "p3", "m", "h", "x", 1.0), ("k4", "p1", "m", "h1", None, 0.0)], "key string, prompt string, model string, prompt_hash string, result string, cost_usd double")
    shipped = spark.createDataFrame([("p1", "h1")], "prompt string, prompt_hash string")
    assert {r.key: r["class"] for r in corpus.prune_classes(cache, shipped).collect()} == {"k1": "reachable", "k2": "edited", "k3": "not shipped", "k4": "unreadable"}
    assert [r.key for r in corpus.cache_misses(spark.createDataFrame([("k1",), ("k9",)], "key string"), cache).collect()] == ["k9"]
    assert {r.prompt: (r.calls, r.cost_usd) for r in corpus.spend(cache).collect()} == {"p1": (3, 0.75), "p3": (1, 1.0)}


def test_outcomes_and_headers(spark):
    a = spark.createDataFrame([("r1", 1.0, None), ("r2", 1.0, 2.0), ("r3", 1.0, 2.0)], "run string, x double, y double")
    b = spark.createDataFrame([("r1", 1.0, None), ("r2", 1.0, 3.0), ("r4", 1.0, 2.0)], "run string, x double, y double")
    assert {r.run: r.state for r in corpus.outcome_states(a, b, ["x", "y"]).collect()} == {"r1": "verified", "r2": "mismatch", "r3": "orphan", "r4": "unbacked"}
    choice = spark.createDataFrame([("t", 1, "f", "o"), ("t", 2, "f", "p")], "tag string, did long, fork string, option string")
    stored = spark.createDataFrame([("t", 2, 2, 1), ("u", 5, 1, 1)], "tag string, n_decisions long, n_options long, n_forks long")
    assert [r.tag for r in corpus.stale_headers(stored, choice).collect()] == ["u"]


def test_locks_and_promotion(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "out")
    corpus.change_lock(spark, log, "spans", "lock", "d1", "frozen for the paper")
    corpus.change_lock(spark, log, "votes", "lock", "d2", "frozen too")
    corpus.change_lock(spark, log, "votes", "unlock", None, "an error was found")
    with pytest.raises(ValueError):
        corpus.change_lock(spark, log, "spans", "unlock", None, " ")
    now = spark.createDataFrame([("spans", "d9"), ("votes", "d2"), ("new", "d3"), ("gone", None)], "layer string, digest string")
    assert {r.layer: r.state for r in corpus.lock_states(spark.read.json(log, schema=corpus.LOCKS), now).collect()} == {"spans": "STALE", "votes": "unlocked", "new": "unlocked", "gone": "absent"}
    corpus.write_tagged(spark.range(3), f"{root}", "t1")
    with pytest.raises(LookupError):
        corpus.promote(spark, root, "t1", ["stats"])
    spark.range(2).write.parquet(f"{root}/tag=t1/stats")
    corpus.promote(spark, root, "t1", ["stats"])
    assert corpus.final(spark, root) == "t1" and corpus.resolve(spark, root, "t1.merged").endswith("tag=t1")
    with pytest.raises(LookupError):
        corpus.resolve(spark, root, "zz")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\tb")], "n int, t string")
    corpus.write_distilled(str(tmp_path / "d"), d, d, d, d)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "d/by_arm")).first().t == "a\tb"
    corpus.write_csv(d, str(tmp_path / "c"))
    corpus.append_log(d, str(tmp_path / "l"))
    corpus.append_log(d, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1
    assert corpus.preflight(spark, [str(tmp_path / "c"), str(tmp_path / "no")]) == [str(tmp_path / "no")]
    (tmp_path / "study.json").write_text('{"corpora": {"x": "/a", "y": "/b"}}')
    assert {(r.corpus, r.root) for r in corpus.study(spark, str(tmp_path / "study.json")).collect()} == {("x", "/a"), ("y", "/b")}
    assert {*corpus.KINDS} >= {"decision", "silent", "misaligned"}


def test_sessions_close(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    e = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(20))], "user_id long, ts timestamp")
    assert sorted(r.events for r in incremental.sessions(e).collect()) == [1, 2]
