"""Audit sets over a vocabulary: its labels, its order, its merges. Each gives rows check, value, verdict."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions import text
from manyways.functions.stats import average_ranks, pearson
from manyways.operators import forks, pairs, sequence
from manyways.operators.cluster import stored
from manyways.operators.resample import SEED, draws, permutation_p, permuted, ranked, renamed, uniform
from manyways.operators.setjoin import similar_sets

SIM_WITHIN = 0.55
SIM_FORK = 0.60
BACKFILL = 0.02


def _rows(t: DataFrame, *checks: tuple[str, Column, Column]) -> DataFrame:
    """One row of measurements as rows of checks; a check without a verdict of its own informs."""
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.round(v.cast("double"), 6).alias("value"), verdict.alias("verdict")) for k, v, verdict in checks])
    return t.select(F.explode(each).alias("x")).select("x.*")


def _passes(c: Column) -> Column:
    return F.when(c, "PASS").otherwise("REVIEW")


def _queued(n: Column) -> Column:
    return F.when(n > 0, "REVIEW").otherwise("INFO")


def alike(labels: DataFrame, least: float, within: str | None = None) -> DataFrame:
    """a < b, similarity of labels (label; of one `within` only): the larger of the overlaps of words and of 3-grams, `least` or more. Pairs
    come from set joins over the rarest words and grams, so none that reaches it is missed and frequent grams are no meeting place."""
    keys = (within,) if within else ()
    d = stored(labels.select(*keys, "label").distinct())  # a vocabulary, which the joins read many times
    d = d.withColumn("words", text.words(F.col("label"))).withColumn("grams", text.grams(F.col("label")))
    found = [similar_sets(d, "label", c, least - 1e-6, keys).select(*keys, "a", "b") for c in ("words", "grams")]
    of = lambda s: d.select(*keys, F.col("label").alias(s), F.col("words").alias(f"w{s}"), F.col("grams").alias(f"g{s}"))
    both = found[0].union(found[1]).distinct().join(of("a"), [*keys, "a"]).join(of("b"), [*keys, "b"])
    score = F.greatest(text.jaccard(F.col("wa"), F.col("wb")), text.jaccard(F.col("ga"), F.col("gb")))
    return both.select(*keys, "a", "b", F.round(score, 6).alias("similarity")).filter(F.col("similarity") >= least)


def same_slot(choice: DataFrame) -> DataFrame:
    """fork, pairs, runs: pairs of a fork's options that the same run holds, and runs that hold any."""
    d = stored(choice.select("run", "fork", "option").distinct())
    both = d.select("run", "fork", F.col("option").alias("a")).join(d.select("run", "fork", F.col("option").alias("b")), ["run", "fork"]).filter("a < b")
    pairs_of = both.select("fork", "a", "b").distinct().groupBy("fork").agg(F.count("*").alias("pairs"))
    runs = d.dropna().groupBy("run", "fork").agg(F.count("*").alias("k")).filter("k > 1").groupBy("fork").agg(F.count("*").alias("runs"))
    return pairs_of.join(runs, "fork")


def vocabulary(choice: DataFrame, wide: int = 8, ratio: float = 0.7, span: int = 5) -> DataFrame:
    """V1 like options of a fork, V2 pairs of alternatives that one run holds, V3 like forks, V4 compound labels, V5 wide forks (many options
    for their runs), V6 options a run comes back to far away, V7 labels that list choices."""
    choice = stored(choice)
    options = choice.select("fork", F.col("option").alias("label")).distinct()
    one = lambda d, name: d.agg(F.count("*").alias(name))
    runs = choice.groupBy("fork").agg(F.countDistinct("run").alias("r"), F.countDistinct("option").alias("o"))
    t = one(alike(options, SIM_WITHIN, "fork"), "v1").crossJoin(same_slot(choice).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("v2"))).crossJoin(one(alike(choice.select(F.col("fork").alias("label")), SIM_FORK), "v3"))
    t = t.crossJoin(one(options.filter(text.clauses(F.col("label")) >= 3), "v4")).crossJoin(one(runs.filter((F.col("r") >= wide) & (F.col("o") / F.col("r") >= ratio)), "v5")).crossJoin(one(sequence.distant(choice, span), "v6")).crossJoin(one(options.filter(text.disjunctive(F.col("label"))), "v7"))  # one row each
    return _rows(t, *[(f"V{i}", F.col(f"v{i}"), _queued(F.col(f"v{i}"))) for i in range(1, 8)])


def coarse(rank: Column) -> Column:
    """Six stages as three: preparation, analysis, report."""
    return F.when(rank <= 2, 0).when(rank <= 4, 1).otherwise(2)


def iteration(choice: DataFrame, null: DataFrame | None = None) -> DataFrame:
    """I2, where a null of the share of steps that return is given (one row: null_mean), how far it lies above the share itself. I1 the share of returns that lie within TIE_LINES lines, I3 Spearman of place and stage, I4 returns per step, I5 the share of the most
    frequent trigger, I6 the share of runs that return over three stages."""
    s = sequence.steps(choice).filter("to is not null")
    back, apart = F.col("to_rank") < F.col("rank"), F.col("to_line") - F.col("line") > sequence.TIE_LINES
    n = lambda c: F.sum(c.cast("long"))
    one = s.agg(n(back).alias("raw"), n(back & apart).alias("kept"), F.count("*").alias("steps"))
    top = s.groupBy("fork").agg(n(back & apart).alias("k")).agg((F.max("k") / F.nullif(F.sum("k"), F.lit(0))).alias("top"))
    place = choice.withColumn("p", F.col("line") / F.max("line").over(Window.partitionBy("run")))
    rho = average_ranks(average_ranks(place.select("p", "rank"), "p", "x"), "rank", "y").agg(pearson("x", "y").alias("rho"))
    three = sequence.returns(choice.withColumn("rank", coarse(F.col("rank")))).select("run").distinct().agg(F.count("*").alias("with"))
    t = one.crossJoin(top).crossJoin(rho).crossJoin(three).crossJoin(choice.agg(F.countDistinct("run").alias("runs")))  # one row each
    ties, many = F.coalesce((F.col("raw") - F.col("kept")) / F.nullif(F.col("raw"), F.lit(0)), F.lit(0.0)), F.col("with") / F.col("runs")
    rows = [("I1", ties, _passes(ties < 0.25)), ("I3", F.col("rho"), _passes(F.col("rho") > 0.25)), ("I4", F.col("kept") / F.col("steps"), F.lit("INFO")), ("I5", F.col("top"), _passes(F.col("top") < 0.25)), ("I6", many, _passes(many > 0.5))]
    if null is not None:
        t = t.crossJoin(null.select("null_mean"))  # one row
        below = F.col("null_mean") - F.col("kept") / F.col("steps")
        rows.insert(1, ("I2", below, _passes(below > 0)))
    return _rows(t, *rows)


def garden(choice: DataFrame, tokens: DataFrame, groups: DataFrame, verdicts: DataFrame, stages: DataFrame, gates: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """G1 the share of like-labelled fork pairs that the screen leaves out since runs reach both, G2 the least share of a merged group's pairs
    (groups: head, fork; verdicts: a, b, relation) that were called siblings, and no veto inside, G3 how many more forks are
    universal after merging, G5 the share of gates that lead to the same or a later stage."""
    size = pairs.sizes(choice, "run", "fork").filter("size >= 8").select("i")
    like = pairs.jaccard(tokens, "token", "fork", 0.34).select("a", "b").join(size.withColumnRenamed("i", "a"), "a").join(size.withColumnRenamed("i", "b"), "b")
    co = like.join(pairs.cooccurrence(choice, "run", "fork"), ["a", "b"], "left").agg(F.count("*").alias("like"), F.coalesce(F.sum((F.coalesce("n", F.lit(0)) > 1).cast("long")), F.lit(0)).alias("blind"))
    v = verdicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "relation")
    inside = groups.select("head", F.col("fork").alias("a")).join(groups.select("head", F.col("fork").alias("b")), "head").filter("a < b").join(v, ["a", "b"], "left")
    density = inside.groupBy("head").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("relation") == "sibling").cast("double"), F.lit(0.0))).alias("d"), F.sum(F.coalesce(F.col("relation").isin("gate", "rival").cast("long"), F.lit(0))).alias("vetoes"))
    safe = density.agg(F.coalesce(F.min(F.when(F.col("n") >= 3, F.col("d"))), F.lit(1.0)).alias("density"), F.coalesce(F.sum(F.when(F.col("n") >= 3, F.col("vetoes"))), F.lit(0)).alias("vetoes"))
    universal = lambda c, name: forks.fork_stats(c).agg(F.sum((F.col("coverage") >= 0.6).cast("long")).alias(name))
    merged = choice.join(groups, "fork", "left").withColumn("fork", F.coalesce("head", "fork")).drop("head")
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    st = lambda n: stages.select(F.col("fork").alias(n), rank[F.col("stage")].alias(f"r{n}"))
    ordered = gates.join(st("a"), "a").join(st("b"), "b").agg(F.count("*").alias("placed"), F.coalesce(F.sum((F.col("ra") <= F.col("rb")).cast("long")), F.lit(0)).alias("agree"))
    t = co.crossJoin(safe).crossJoin(universal(choice, "before")).crossJoin(universal(merged, "after")).crossJoin(ordered)  # one row each
    blind, agree = F.when(F.col("like") > 0, F.col("blind") / F.col("like")).otherwise(0.0), F.when(F.col("placed") > 0, F.col("agree") / F.col("placed")).otherwise(1.0)
    return _rows(t, ("G1", blind, _passes(blind < 0.5)), ("G2", F.col("density"), _passes((F.col("density") >= 0.5) & (F.col("vetoes") == 0))), ("G3", F.col("after") - F.col("before"), F.lit("INFO")), ("G5", agree, _passes(agree >= 0.6)))


def clusters(choice: DataFrame, values: DataFrame, negated: DataFrame, backfilled: DataFrame | None = None) -> DataFrame:
    """A: options with members whose cut-offs (did, values) contradict each other, options with members that do and don't negate (did,
    negated), like options of a fork (0.8 or more), the share of option pairs that no run shares, and, where decisions are given that no
    merge placed (backfilled: did), their share of all."""
    choice = stored(choice.select("did", "run", "fork", "option"))
    c = choice.select("did", "fork", "option")
    sets = c.join(values.filter(F.size("values") > 0), "did").select("fork", "option", "values").distinct()
    x, y = sets.withColumnRenamed("values", "v"), sets.withColumnRenamed("values", "w")
    clash = x.join(y, ["fork", "option"]).filter((F.col("v") < F.col("w")) & (F.size(F.array_except("v", "w")) > 0) & (F.size(F.array_except("w", "v")) > 0)).select("fork", "option").distinct()
    polar = c.join(negated, "did").groupBy("fork", "option").agg(F.countDistinct("negated").alias("k")).filter("k > 1")
    one = lambda d, n: d.agg(F.count("*").alias(n))
    near = alike(choice.select("fork", F.col("option").alias("label")), 0.8, "fork")
    n = choice.groupBy("fork").agg(F.countDistinct("option").alias("o")).agg(F.sum(F.col("o") * (F.col("o") - 1) / 2).alias("pairs"))
    shared = same_slot(choice).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("shared"))
    t = one(clash, "numeric").crossJoin(one(polar, "negation")).crossJoin(one(near, "near")).crossJoin(n).crossJoin(shared)  # one row each
    exclusive = 1 - F.col("shared") / F.col("pairs")
    rows = [("numeric", F.col("numeric"), _passes(F.col("numeric") == 0)), ("negation", F.col("negation"), _passes(F.col("negation") == 0)), ("near", F.col("near"), _queued(F.col("near"))), ("exclusive", exclusive, _passes(exclusive >= 0.9))]
    if backfilled is not None:
        t = t.crossJoin(one(backfilled, "backfilled")).crossJoin(one(choice, "decisions"))  # one row each
        rate = F.col("backfilled") / F.col("decisions")
        rows.append(("backfill", rate, _passes(rate < BACKFILL)))
    return _rows(t, *rows)


#: Strata of forks by runs.
STRATA = ((2, 4), (5, 9), (10, 29), (30, None))


def granularity(choice: DataFrame, actions: DataFrame) -> DataFrame:
    """Per stratum of forks by runs (two options or more): forks, options, actions that readers tell apart (fork, n), and actions per option."""
    t = choice.groupBy("fork").agg(F.countDistinct("run").alias("r"), F.countDistinct("option").alias("o")).filter("o >= 2 and r >= 2").join(actions, "fork")
    name = F.lit(None).cast("string")
    for low, high in STRATA:
        name = F.when((F.col("r") >= low) & (F.lit(True) if high is None else F.col("r") <= high), f"{low}-{high}" if high else f"{low}+").otherwise(name)
    return t.groupBy(name.alias("stratum")).agg(F.count("*").alias("forks"), F.sum("o").alias("options"), F.sum("n").alias("actions"), F.round(F.sum("n") / F.sum("o"), 6).alias("ratio"))


def neighbours(choice: DataFrame, tokens: DataFrame, words: DataFrame, least: float = 0.55, reach: int = 4, expected: float = 4.0) -> DataFrame:
    """Fork pairs that may be one question: 1.6 * overlap of labels (tokens: fork, token) + 1.0 * overlap of option words (words: fork, token) +
    0.9 where no run reaches both although `expected` would; above `least`, both with `reach` runs. Pairs come from shared words and
    from mutually exclusive forks, which may share none."""
    size = pairs.sizes(choice, "run", "fork").filter(F.col("size") >= reach)
    n = choice.agg(F.countDistinct("run").alias("runs"))
    label, option = pairs.jaccard(tokens, "token", "fork").select("a", "b", F.col("jaccard").alias("l")), pairs.jaccard(words, "token", "fork").select("a", "b", F.col("jaccard").alias("o"))
    # forks with so few runs that no partner could be expected `expected` times are no candidates for exclusion
    big = size.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(size.agg(F.max("size").alias("top")))).filter(F.col("size") * F.col("top") / F.col("runs") >= expected)  # one row each
    x, y = big.select(F.col("i").alias("a"), F.col("size").alias("x"), "runs"), big.select(F.col("i").alias("b"), F.col("size").alias("y"))
    apart = x.join(y, (F.col("a") < F.col("b")) & (F.col("x") * F.col("y") >= expected * F.col("runs"))).join(pairs.cooccurrence(choice, "run", "fork"), ["a", "b"], "left_anti").select("a", "b", F.lit(1).alias("e"))
    t = label.join(option, ["a", "b"], "full_outer").join(apart, ["a", "b"], "full_outer").fillna(0.0, ["l", "o"]).fillna(0, ["e"])
    t = t.join(size.select(F.col("i").alias("a")), "a").join(size.select(F.col("i").alias("b")), "b")
    score = 1.6 * F.col("l") + F.col("o") + 0.9 * F.col("e")
    source = F.when(F.col("l") > 0, "label").when(F.col("o") > 0, "options").otherwise("exclusion")
    return t.select("a", "b", F.round(score, 6).alias("score"), source.alias("source")).filter(F.col("score") > least)


def co_reach(choice: DataFrame, null: DataFrame) -> DataFrame:
    """Edges between forks that runs reach together more, or less, often than under a null (a, b, n, p, null_mean)."""
    return null.select("a", "b", "n", "p", F.when(F.col("n") > F.col("null_mean"), "together").otherwise("apart").alias("dir"))


def excluded(apart: DataFrame, screened: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mutually exclusive pairs (a, b), with whether the label screen had them and what an adjudication said."""
    s = screened.select("a", "b", F.lit(True).alias("screened"))
    return apart.select("a", "b").join(s, ["a", "b"], "left").join(verdicts, ["a", "b"], "left").select("a", "b", F.coalesce("screened", F.lit(False)).alias("screened"), F.coalesce("relation", F.lit("not judged")).alias("relation"))


def sectors(choice: DataFrame, floor: float = 0.075, power: float = 0.75) -> DataFrame:
    """fork, width: shares of a circle by reach ** power, none below `floor` of the mean share, adding up to 1."""
    s = forks.reach(choice).withColumn("w", F.pow(F.col("runs").cast("double"), F.lit(power)))
    one = Window.partitionBy()  # a vocabulary
    t = s.withColumn("x", F.greatest(F.col("w") / F.sum("w").over(one), floor / F.count("*").over(one)))
    return t.select("fork", F.round(F.col("x") / F.sum("x").over(one), 6).alias("width"))


#: So many draws' runs and recipes are in a worker at once.
DRAWN = 2_000_000


def recipes_null(choice: DataFrame, n: int = 1000, least: float = 0.6, seed: int = SEED) -> DataFrame:
    """One row: distinct full rows of universal forks, and how many there would be if runs chose at each fork independently by the shares
    that the same complete runs have. Options are numbers in the order of names, a recipe is one number of theirs (a hash where they are
    too many); a worker draws a batch of runs for all draws, and only its distinct recipes of each draw leave it."""
    m = forks.modal(choice)
    universal = forks.fork_stats(choice).filter(F.col("coverage") >= least).select("fork")
    names = sorted(r["fork"] for r in universal.collect())  # a vocabulary
    m = m.join(F.broadcast(universal), "fork").dropna(subset=["run"])
    rows = stored(m.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("fork", "option"))).alias("at")).filter(F.size("at") == len(names)))
    counts = rows.select(F.explode("at").alias("x")).groupBy("x.fork", "x.option").agg(F.count("*").alias("k"))
    ends: dict[str, list[int]] = {f: [] for f in names}
    for r in counts.orderBy("fork", "option").collect():  # vocabularies
        ends[r["fork"]].append(r["k"] + (ends[r["fork"]][-1] if ends[r["fork"]] else 0))
    size = max((e[-1] for e in ends.values() if e), default=0)
    tables = [np.array(ends[f], np.int64) for f in names]
    exact = np.prod([float(len(t)) for t in tables]) < 2**62
    each = 1 + DRAWN // 10_000

    def drawn(batches):
        def mix(x):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.uint64)
            for first in range(0, n, each):
                found = []
                for d in range(first, min(n, first + each)):
                    path = np.zeros(len(key), np.uint64)
                    for f, table in enumerate(tables):
                        u = mix(mix(key + np.uint64(seed)) + np.uint64((d * len(tables) + f + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)
                        option = np.searchsorted(table, (u * (size / 2**53)).astype(np.int64), "right").astype(np.uint64)
                        path = path * np.uint64(len(table)) + option if exact else mix(path + np.uint64(0x9E3779B97F4A7C15) * (option + np.uint64(1)))
                    found.append(np.unique(path))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + len(found), dtype=np.int32), [*map(len, found)])), pa.array(np.concatenate(found).astype(np.int64))], ["draw", "path"])

    paths = rows.select(F.to_json("at").alias("path")).distinct().agg(F.count("*").cast("double").alias("paths"))
    runs = rows.select(F.xxhash64("run").alias("key")).repartition(rows.sparkSession.sparkContext.defaultParallelism * 4)
    t = runs.mapInArrow(drawn, "draw int, path long").distinct().groupBy("draw").agg(F.count("*").cast("double").alias("x")).crossJoin(F.broadcast(paths))  # one row
    return t.agg(F.first("paths").alias("paths"), F.avg("x").alias("null_mean"), F.min("x").alias("null_min"), F.max("x").alias("null_max"), F.avg((F.col("x") <= F.col("paths")).cast("double")).alias("p"))


#: So many runs of a draw are counted at once, and no task is made for fewer than so many; so many rows are dealt at once.
SLICE = 8192
LEAST = 512
DEALT = 1_000_000
#: Meetings of an option's and a drawn fork's run that are counted at once.
MEETINGS = 2_000_000


def gate_null(choice: DataFrame, n: int = 1000, seed: int = SEED) -> DataFrame:
    """draw, gates: how many (fork, option, later fork) triples meet the gates' shares when who reaches a fork is random, at the same sizes of
    forks and options: in each draw every fork's runs are renamed by a permutation of its own for the side that is reached. Runs are dealt to
    tasks; a task counts its runs' meetings of options and drawn forks, never made as rows, in one row of counts for each option: few tasks a draw, so
    that counts are as many as tasks, not as slices of runs. One draw is dealt after the other, as bytes, and its shuffle files go before the next. What can't be a gate
    (too rare options, or too common ones) isn't counted. Rows without a run, and options and forks without a name, don't count."""
    spark = choice.sparkSession
    d = stored(choice.select("fork", "option", "run").dropna(subset=["fork", "run"]).distinct())
    size = stored(forks.positions(choice).select("fork", "position", F.col("runs").alias("size")).dropna(subset=["fork"]).filter("size >= 8"))
    n1 = d.dropna(subset=["option"]).groupBy("fork", "option").agg(F.count("*").alias("n1")).join(size, "fork").filter("n1 >= 5 and size - n1 >= 5")
    vocabulary = [r["fork"] for r in size.select("fork").orderBy("fork").collect()]  # vocabularies
    kept = n1.select("fork", "option", "n1", "size").orderBy("fork", "option").collect()
    every = spark.range(n).select(F.col("id").cast("int").alias("draw"))
    if not kept:
        return every.withColumn("gates", F.lit(0).cast("long"))
    number = {f: i for i, f in enumerate(vocabulary)}
    at = size.sparkSession.createDataFrame([(f, i) for f, i in number.items()], "fork string, f int")
    place = np.zeros(len(vocabulary))
    for r in size.select("fork", "position").collect():
        place[number[r["fork"]]] = r["position"]
    items, of = [], []  # a fork's own number, then its options'
    for r in kept:
        f = number[r["fork"]]
        if not of or of[-1][0] != f:
            items.append((r["fork"], None, len(of)))
            of.append((f, 0, r["size"]))
        items.append((r["fork"], r["option"], len(of)))
        of.append((f, r["n1"], r["size"]))
    x = F.broadcast(spark.createDataFrame(items, "fork string, option string, x int"))
    runs = ranked(d.select("run").distinct(), "run")
    total = runs.count()
    tasks = min(1 + total // LEAST, 2 * spark.sparkContext.defaultParallelism)  # of a draw; each has one table of counts
    slices = max(tasks, 1 + total // SLICE)
    reach = stored(d.select("fork", "run").distinct().join(runs, "run").select("fork", "j"))
    own = reach.join(x.filter("option is null"), "fork").select("j", "x").union(d.join(runs, "run").join(x.filter("option is not null"), ["fork", "option"]).select("j", "x"))
    drawn = reach.join(F.broadcast(at), "fork").select("j", (-1 - F.col("f")).alias("x"))
    heads = {f: i for i, (f, own_runs, _) in enumerate(of) if not own_runs}
    many, forks_of = len(vocabulary), np.array(of, np.int64)

    def dealt(draw: int):
        """part (a slice of runs), j and x as bytes: own rows as they are, reached forks (x < 0) with their runs renamed."""

        def large(batches):
            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= DEALT:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
            if rows:
                yield pa.Table.from_batches(held)

        def each(batches):
            for batch in large(batches):
                j, x = (batch.column(i).to_numpy() for i in range(2))
                to = np.where(x < 0, renamed(j, -1 - x, draw, total, seed), j)
                part = to % slices
                order = np.argsort(part, kind="stable")
                parts, begin = np.unique(part[order], return_index=True)
                cells = [[c[k].tobytes() for k in np.split(order, begin[1:])] if len(order) else [] for c in (to.astype(np.int64), x.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(parts % tasks, pa.int32()), pa.array(parts.astype(np.int64)), *(pa.array(c, pa.binary()) for c in cells)], ["task", "part", "j", "x"])

        return each

    def add(counts: np.ndarray, j: np.ndarray, x: np.ndarray) -> None:
        mine = x >= 0
        run, item, met, other = j[mine], x[mine].astype(np.int64), j[~mine], -1 - x[~mine].astype(np.int64)
        low = np.searchsorted(met, run, "left")
        times = np.searchsorted(met, run, "right") - low
        ends = np.cumsum(times)
        begin = 0
        while begin < len(run):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MEETINGS, "right")))
            k = times[begin:end]
            where = np.repeat(low[begin:end] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            np.add.at(counts, np.repeat(item[begin:end] * many, k) + other[where], 1)
            begin = end

    def counted(draw: int):
        """draw, a, x and the item's counts with all forks, over a stream sorted by part."""

        def each(batches):
            counts, at, held = np.zeros(len(of) * many, np.int32), None, []

            def close() -> None:
                j, x = np.concatenate([np.frombuffer(c, np.int64) for c, _ in held]), np.concatenate([np.frombuffer(c, np.int32) for _, c in held])
                order = np.argsort(j, kind="stable")
                add(counts, j[order], x[order])
                held.clear()

            for batch in batches:
                for part, j, x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    if part != at and held:
                        close()
                    at = part
                    held.append((j, x))
            if held:
                close()
            table = counts.reshape(-1, many)
            for first in range(0, len(table), 256):
                some = np.flatnonzero(table[first : first + 256].any(axis=1)) + first
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), draw, np.int32)), pa.array(forks_of[some, 0].astype(np.int32)), pa.array(some.astype(np.int32)), pa.array([table[i].tobytes() for i in some], pa.binary())], ["draw", "a", "x", "counts"])

        return each

    def judged(batches):
        """draw, gates over a stream of counts sorted by draw and a: those of one fork's items are added up and compared."""

        def gates() -> int:
            reached, found = sums.get(heads[key[1]]), 0
            for i, hit in sums.items():
                f, own, all_runs = of[i]
                if own:
                    fine = (hit >= 5) & (place > place[f]) & (hit / own >= 0.25) & ((reached - hit) / (all_runs - own) <= 0.06)
                    fine[f] = False
                    found += int(fine.sum())
            return found

        key, sums, out = None, {}, {}
        for batch in batches:
            for draw, a, i, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != (draw, a):
                    if key:
                        out[key[0]] = out.get(key[0], 0) + gates()
                    key, sums = (draw, a), {}
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        if key:
            out[key[0]] = out.get(key[0], 0) + gates()
        yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), pa.array([*out.values()], pa.int64())], ["draw", "gates"])

    rows, found = stored(own.union(drawn)), None
    for draw in range(n):
        parts = rows.mapInArrow(dealt(draw), "task int, part long, j binary, x binary").repartition(tasks, "task").sortWithinPartitions("part")  # a number, so that parts aren't put together
        counts = parts.mapInArrow(counted(draw), "draw int, a int, x int, counts binary").repartition("draw", "a").sortWithinPartitions("draw", "a")
        one = stored(counts.mapInArrow(judged, "draw int, gates long").groupBy("draw").agg(F.sum("gates").alias("gates")), freed=True)
        found = one if found is None else found.union(one)
    if found is None:
        return every.withColumn("gates", F.lit(0).cast("long"))
    return every.join(found, "draw", "left").fillna(0, ["gates"])


def auc_null(df: DataFrame, score: str, positive: str, key: str, n: int = 20000, seed: int = SEED) -> DataFrame:
    """One row: the AUC of score, and how often shuffled labels lie as far from a half: p = (draws + 1) / (n + 1). Ranks are found once."""
    t = average_ranks(df.select(key, F.col(positive).cast("double").alias("y"), F.col(score).alias("_score")), "_score", "r").select(key, "y", "r")
    one = t.agg(F.sum("y").alias("k"), F.sum(1 - F.col("y")).alias("m"))
    auc = lambda d, *keys: d.groupBy(*keys).agg(F.sum(F.col("y") * F.col("r")).alias("s")).crossJoin(F.broadcast(one)).select(*keys, ((F.col("s") - F.col("k") * (F.col("k") + 1) / 2) / (F.col("k") * F.col("m"))).alias("auc"))
    null = auc(permuted(draws(t.withColumn("_g", F.lit(1)), n), "y", ["_g"], key, seed), "draw").select(F.abs(F.col("auc") - 0.5).alias("off"))
    u = null.crossJoin(F.broadcast(auc(t)))  # one row
    return u.agg(F.first("auc").alias("auc"), F.count("*").alias("draws"), ((F.sum((F.col("off") >= F.abs(F.col("auc") - 0.5) - 1e-12).cast("long")) + 1) / (F.count("*") + 1)).alias("p"))


def contraction_null(items: DataFrame, targets_a: list[int], targets_b: list[int], n: int = 200, seed: int = SEED) -> DataFrame:
    """draw, ari: agreement of two builds (a and b of the same items) after each one's clusters are merged at random into groups of the given
    sizes: shuffled, largest first, each whole into the group with the most room left. A draw handles clusters, not items."""
    import numpy as np
    import pandas as pd

    from manyways.operators.agreement import adjusted_rand

    sizes = items.groupBy(F.lit("a").alias("side"), F.col("a").cast("string").alias("cluster")).agg(F.count("*").alias("n")).union(items.groupBy(F.lit("b"), F.col("b").cast("string")).agg(F.count("*")))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        draw, side = int(pdf["draw"].iloc[0]), pdf["side"].iloc[0]
        room = np.array(sorted(targets_a if side == "a" else targets_b, reverse=True), float)
        order = np.random.default_rng([seed, draw, side == "b"]).permutation(len(pdf))
        pdf = pdf.sort_values("cluster").iloc[order].sort_values("n", ascending=False, kind="stable")
        to = []
        for size in pdf["n"]:
            j = int(room.argmax())
            room[j] -= size
            to.append(j)
        return pd.DataFrame({"draw": draw, "side": side, "cluster": pdf["cluster"], "to": to})

    moved = draws(sizes, n).groupBy("draw", "side").applyInPandas(merge, "draw int, side string, cluster string, to int")
    label = lambda side: moved.filter(F.col("side") == side).select("draw", F.col("cluster").alias(side), F.col("to").alias(f"{side}2"))
    cells = items.groupBy(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).agg(F.count("*").alias("w"))
    t = cells.join(label("a"), "a").join(label("b"), ["draw", "b"]).select("draw", F.col("a2").alias("a"), F.col("b2").alias("b"), "w")
    return adjusted_rand(t, "draw", weight="w").select("draw", "ari")
