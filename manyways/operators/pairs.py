"""Pairs of items that share keys: co-occurrence, overlap screens, association, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions.stats import benjamini_hochberg, fisher_tail
from manyways.operators.cluster import stored
from manyways.operators.forks import modal, positions


def cooccurrence(df: DataFrame, key: str, item: str) -> DataFrame:
    """a < b and how many keys have both, by a self-join on the key."""
    d = df.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    return d.select("k", F.col("i").alias("a")).join(d.select("k", F.col("i").alias("b")), "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def sizes(df: DataFrame, key: str, item: str) -> DataFrame:
    return df.groupBy(F.col(item).alias("i")).agg(F.countDistinct(key).alias("size"))


def jaccard(df: DataFrame, key: str, item: str, least: float = 0.0) -> DataFrame:
    """Jaccard similarity and smaller-side containment of items that share a key."""
    s = sizes(df, key, item)
    j = cooccurrence(df, key, item).join(s.select(F.col("i").alias("a"), F.col("size").alias("na")), "a").join(s.select(F.col("i").alias("b"), F.col("size").alias("nb")), "b")
    out = j.select("a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"), F.round(F.col("n") / F.least("na", "nb"), 6).alias("containment"))
    return out.filter(F.col("jaccard") >= least)


def exclusive(choice: DataFrame, least: float = 4.0) -> DataFrame:
    """Fork pairs that no run reaches both of although `least` or more would be expected: the pairs that a shared-key join can't see."""
    s = sizes(choice, "run", "fork").withColumnRenamed("i", "fork")
    n = choice.agg(F.countDistinct("run").alias("runs"))
    a, b = s.select(F.col("fork").alias("a"), F.col("size").alias("na")), s.select(F.col("fork").alias("b"), F.col("size").alias("nb"))
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(n)).withColumn("expected", F.round(F.col("na") * F.col("nb") / F.col("runs"), 6))  # n: one row
    return pairs.filter(F.col("expected") >= least).join(cooccurrence(choice, "run", "fork"), ["a", "b"], "left_anti").select("a", "b", "expected")


def option_clashes(choice: DataFrame, least: float = 0.25) -> DataFrame:
    """Option pairs of one fork that the same runs hold: shared runs over the smaller option's."""
    d = choice.select("run", "fork", "option").distinct()
    s = d.groupBy("fork", "option").agg(F.count("*").alias("size"))
    j = d.select("run", "fork", F.col("option").alias("a")).join(d.select("run", "fork", F.col("option").alias("b")), ["run", "fork"]).filter("a < b").groupBy("fork", "a", "b").agg(F.count("*").alias("n"))
    j = j.join(s.select("fork", F.col("option").alias("a"), F.col("size").alias("na")), ["fork", "a"]).join(s.select("fork", F.col("option").alias("b"), F.col("size").alias("nb")), ["fork", "b"])
    return j.withColumn("share", F.round(F.col("n") / F.least("na", "nb"), 6)).filter(F.col("share") > least).select("fork", "a", "b", "n", "share")


def coded(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """d (fork, option, run) as a stored table run, f, c with numbers for forks and options, which are shorter to shuffle and compare than
    names; and the vocabulary c, f, fork, option, in the order of names."""
    names = d.select("fork", "option").distinct()
    by = Window.orderBy("fork", "option")  # a vocabulary
    vocabulary = stored(names.select(F.row_number().over(by).alias("c"), F.dense_rank().over(Window.orderBy("fork")).alias("f"), "fork", "option"))
    return stored(d.join(vocabulary, ["fork", "option"]).select("run", "f", "c")), vocabulary


def cramers_v(choice: DataFrame, least: int = 20, reach: int = 100) -> DataFrame:
    """Association of the modal options at two forks (with `reach` runs or more each) over runs that face both (`least` or more)."""
    m, names = coded(modal(choice))
    m = m.join(m.groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= reach).select("f"), "f")
    cell = m.select("run", F.col("f").alias("a"), F.col("c").alias("x")).join(m.select("run", F.col("f").alias("b"), F.col("c").alias("y")), "run").filter("a < b").groupBy("x", "y").agg(F.count("*").alias("o"))
    forks = names.select("c", "f")
    cell = cell.join(forks.select(F.col("c").alias("x"), F.col("f").alias("a")), "x").join(forks.select(F.col("c").alias("y"), F.col("f").alias("b")), "y")
    w = lambda *c: F.sum("o").over(Window.partitionBy("a", "b", *c))
    t = cell.repartition("a", "b").select("a", "b", "o", w("x").alias("r"), w("y").alias("c"), w().alias("n"), "x", "y")  # one shuffle serves all
    out = t.groupBy("a", "b").agg(F.max("n").alias("runs"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"))
    k = F.least("kx", "ky") - 1
    out = out.filter((F.col("runs") >= least) & (k > 0)).select("a", "b", "runs", F.round(F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / k), 6).alias("v"))
    return _named(out, names)


def _named(df: DataFrame, names: DataFrame) -> DataFrame:
    """Names for the numbers of forks in a and b."""
    f = names.select("f", "fork").distinct()
    for c in ("a", "b"):
        df = df.withColumnRenamed(c, "f").join(f, "f").withColumnRenamed("fork", c).drop("f")
    return df


def sibling_screen(choice: DataFrame, tokens: DataFrame, most_shared: int = 1, overlap: float = 0.34, least: int = 8, options: DataFrame | None = None, stages: DataFrame | None = None) -> DataFrame:
    """Fork pairs with like labels (tokens: fork, token) that hardly any run reaches both of: candidates for one question asked twice, with the
    overlap of their options (fork, option) and whether they are of one stage (fork, stage), if given. Ranked by overlap and reach."""
    s = sizes(choice, "run", "fork").filter(F.col("size") >= least)
    like = jaccard(tokens, "token", "fork", overlap).select("a", "b", "jaccard")
    j = like.join(s.select(F.col("i").alias("a"), F.col("size").alias("na")), "a").join(s.select(F.col("i").alias("b"), F.col("size").alias("nb")), "b")
    j = j.join(cooccurrence(choice, "run", "fork"), ["a", "b"], "left").withColumn("shared", F.coalesce("n", F.lit(0))).filter(F.col("shared") <= most_shared)
    more = []
    if options is not None:
        j = j.join(jaccard(options, "option", "fork").select("a", "b", F.col("jaccard").alias("_o")), ["a", "b"], "left")
        more.append(F.coalesce("_o", F.lit(0.0)).alias("option_overlap"))
    if stages is not None:
        j = j.join(stages.select(F.col("fork").alias("a"), F.col("stage").alias("_sa")), "a", "left").join(stages.select(F.col("fork").alias("b"), F.col("stage").alias("_sb")), "b", "left")
        more.append(F.col("_sa").eqNullSafe(F.col("_sb")).alias("same_stage"))
    return j.select("a", "b", "jaccard", "shared", *more, F.round(F.col("jaccard") + F.greatest("na", "nb") / 400, 6).alias("score"))


def strongest(choice: DataFrame, k: int = 60) -> DataFrame:
    """The k pairs of options that most runs hold both of, as evidence for a reader."""
    t = choice.select("run", F.concat_ws("|", "fork", "option").alias("option"))
    return cooccurrence(t, "run", "option").orderBy(F.desc("n"), "a", "b").limit(k)


def exclusivity(choice: DataFrame, least: float = 0.25, few: int = 5) -> DataFrame:
    """One row: option pairs of one fork, how many of them clash (option_clashes()), forks with one option, the median runs of a fork, and forks
    with fewer than `few` runs."""
    f = choice.groupBy("fork").agg(F.countDistinct("option").alias("o"), F.countDistinct("run").alias("r"))
    t = f.agg(F.sum(F.col("o") * (F.col("o") - 1) / 2).cast("long").alias("pairs"), F.sum((F.col("o") == 1).cast("long")).alias("orphans"), F.median("r").alias("median_runs"), F.sum((F.col("r") < few).cast("long")).alias("small"))
    return t.crossJoin(option_clashes(choice, least).agg(F.count("*").alias("clashes")))  # one row each


def _faced(choice: DataFrame, reach: int):
    """Of forks with `reach` runs or more: their option sets (run, f, c), runs (run, f), sizes and positions (f, na, position), and names."""
    choice = stored(choice.select("did", "run", "line", "fork", "option"))
    d, names = coded(choice.select("fork", "option", "run").distinct())
    runs = d.select("run", "f").distinct()
    place = positions(choice).select("fork", "position").join(names.select("f", "fork").distinct(), "fork")
    size = stored(runs.groupBy("f").agg(F.count("*").alias("na")).filter(F.col("na") >= reach).join(place, "f").select("f", "na", "position"))
    return d.join(size.select("f"), "f"), runs.join(size.select("f"), "f"), size, names


def _triples(d: DataFrame, runs: DataFrame, size: DataFrame, least: int) -> DataFrame:
    """(a, option c, later fork b) that `least` runs of the option reach, with the sizes that the rules compare. How many of a's runs reach b
    at all is one count per pair of forks."""
    n1 = d.groupBy("f", "c").agg(F.count("*").alias("n1"))
    a = size.select(F.col("f").alias("a"), "na", F.col("position").alias("pa")).join(n1.withColumnRenamed("f", "a"), "a")
    a = a.filter((F.col("n1") >= least) & (F.col("na") - F.col("n1") >= least))
    hit = d.withColumnRenamed("f", "a").join(runs.withColumnRenamed("f", "b"), "run").filter("a <> b").groupBy("c", "b").agg(F.count("*").alias("hit")).filter(F.col("hit") >= least)
    hits = cooccurrence(runs, "run", "f").withColumnRenamed("n", "hits")
    hits = hits.union(hits.select("b", "a", "hits"))
    t = hit.join(a, "c").join(size.select(F.col("f").alias("b"), F.col("position").alias("pb")), "b").filter(F.col("pb") > F.col("pa")).join(hits, ["a", "b"])
    return t.withColumn("p0", (F.col("hits") - F.col("hit")) / (F.col("na") - F.col("n1"))).withColumn("p1", F.col("hit") / F.col("n1"))


def gates(choice: DataFrame, least: int = 5, most_without: float = 0.06, least_with: float = 0.25, q: float = 0.05, reach: int = 8) -> DataFrame:
    """Options (of fork a) after which a later fork b is reached and without which it hardly ever is: Fisher's one-sided p, up to the
    Benjamini-Hochberg threshold over all that were tested."""
    d, runs, size, names = _faced(choice, reach)
    t = _triples(d, runs, size, least).filter((F.col("p0") <= most_without) & (F.col("p1") >= least_with))
    tested = stored(fisher_tail(t, "hit", "n1", "hits", "na"))
    limit = benjamini_hochberg(tested, "p", q).select("threshold")
    kept = tested.crossJoin(F.broadcast(limit)).filter("p <= threshold").join(names.select("c", "option"), "c")  # one row
    return _named(kept.select("a", "option", "b", "hit", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), F.round("p", 9).alias("p")), names)


def gate_funnel(choice: DataFrame, least: int = 5, most_without: float = 0.06, least_with: float = 0.25, reach: int = 8) -> DataFrame:
    """rule, n: how many options, and then (fork, option, later fork) triples, stop at which rule first. Triples that no run takes are
    counted, not made."""
    d, runs, size, _ = _faced(choice, reach)
    later = Window.orderBy("position").rangeBetween(Window.unboundedPreceding, 0)  # over forks
    size = size.withColumn("earlier", F.count("*").over(later) - 1).withColumn("forks", F.count("*").over(Window.partitionBy()) - 1)
    o = d.groupBy("f", "c").agg(F.count("*").alias("n1")).join(size, "f")
    kind = F.when(F.col("n1") < least, "option too rare").when(F.col("na") - F.col("n1") < least, "no comparison group").otherwise("not later")
    options = o.groupBy(kind.alias("rule")).agg(F.sum(F.when(kind == "not later", F.col("earlier")).otherwise(1)).alias("n"), F.sum(F.when(kind == "not later", F.col("forks") - F.col("earlier")).otherwise(0)).alias("rest"))
    t = _triples(d, runs, size, least)
    stop = F.when(F.col("p0") > most_without, "others reach it too").when(F.col("p1") < least_with, "most don't reach it").otherwise("tested")
    taken = stored(t.groupBy(stop.alias("rule")).agg(F.count("*").alias("n")))
    few = options.agg(F.sum("rest").alias("r")).crossJoin(taken.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))).select(F.lit("too few runs").alias("rule"), (F.col("r") - F.col("k")).alias("n"))  # one row each
    return options.select("rule", "n").union(taken).union(few)
