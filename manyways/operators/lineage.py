"""Lineage audit: options traced down to raw operations, neighbouring forks judged for identity, and what merging left alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions import text
from manyways.operators.cluster import stored
from manyways.operators.resample import SEED
from manyways.operators.setjoin import similar_sets

#: The stop words of this audit, how many raw operations an option needs and shows, and the weights and bounds of neighbours.
STOP = tuple("how is are the a an of to into for from in on at by with and or what which used use does do this that it its as be when where primary model analysis data".split())
LEAST_RAW = 3
MOST_SHOWN = 14
LABEL, OPTIONS, EXCLUSIVE = 1.6, 1.0, 0.9
SCORE = 0.55
LEAST_RUNS = 4
EXPECTED = 4
RESIDUE = 0.6


def tokens(label: Column) -> Column:
    return text.tokens(F.coalesce(label, F.lit("")), STOP)


def traced(members: DataFrame, forks: int = 25, options: int = 3, seed: int = SEED) -> DataFrame:
    """fork, option, n_members, id, did, text: of `forks` forks, drawn by hash, the `options` options with the most members (ties by name), and of
    each at most MOST_SHOWN raw operations, also by hash, numbered from 0. members: fork, option, did, text. Options with fewer than
    LEAST_RAW members have nothing to test."""
    pool = members.groupBy("fork", "option").agg(F.count("*").alias("n_members")).filter(F.col("n_members") >= LEAST_RAW)
    picked = pool.select("fork").distinct().orderBy(F.xxhash64(F.lit(seed), "fork"), "fork").limit(forks)
    of_fork = Window.partitionBy("fork").orderBy(F.desc("n_members"), "option")
    chosen = pool.join(F.broadcast(picked), "fork").withColumn("_place", F.row_number().over(of_fork)).filter(F.col("_place") <= options).drop("_place")
    by_hash = Window.partitionBy("fork", "option").orderBy(F.xxhash64(F.lit(seed), "fork", "option", "did"), "did")
    shown = members.join(F.broadcast(chosen), ["fork", "option"]).withColumn("id", F.row_number().over(by_hash) - 1)
    return shown.filter(F.col("id") < MOST_SHOWN).select("fork", "option", "n_members", "id", "did", F.trim(F.coalesce("text", F.lit(""))).alias("text"))


def checked_purity(shown: DataFrame, verdicts: DataFrame) -> DataFrame:
    """fork, option, n_members, n_shown, verdict, n_rejects, fault of every traced option: verdicts (fork, option, verdict, rejects: ids of shown
    operations) that keep the rules have no fault. A verdict is coherent, impure or split; rejects are ids that were shown; an impure option
    has one or more, a coherent one none. An option without a verdict is `unanswered`."""
    per = shown.groupBy("fork", "option", "n_members").agg(F.count("*").alias("n_shown"))
    t = per.join(verdicts.select("fork", "option", "verdict", F.coalesce("rejects", F.array().cast("array<int>")).alias("rejects")), ["fork", "option"], "left")
    n = F.size("rejects")
    fault = (
        F.when(F.col("rejects").isNull(), "unanswered")
        .when(F.col("verdict").isNull() | ~F.col("verdict").isin("coherent", "impure", "split"), "no verdict")
        .when(F.exists("rejects", lambda i: i.isNull() | (i < 0) | (i >= F.col("n_shown"))), "reject not shown")
        .when((F.col("verdict") == "impure") & (n == 0), "impure without a reject")
        .when((F.col("verdict") == "coherent") & (n > 0), "coherent with rejects")
    )
    return t.select("fork", "option", "n_members", "n_shown", "verdict", F.when(F.col("rejects").isNotNull(), n).otherwise(0).alias("n_rejects"), fault.alias("fault"))


def purity(checked: DataFrame) -> DataFrame:
    """One row over verdicts without a fault: options traced, raw operations read, coherent, impure and split options with their shares,
    rejected operations and their share."""
    fine = checked.filter("fault is null")
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    t = fine.agg(F.count("*").alias("traced"), F.coalesce(F.sum("n_shown"), F.lit(0)).alias("raw_read"), *(n(v).alias(v) for v in ("coherent", "impure", "split")), F.coalesce(F.sum("n_rejects"), F.lit(0)).alias("rejected"))
    share = lambda c, of: F.round(F.col(c) / F.greatest(F.col(of), F.lit(1)), 6).alias(f"{c}_share")
    return t.select("*", *(share(c, "traced") for c in ("coherent", "impure", "split")), share("rejected", "raw_read"))


def neighbours(members: DataFrame, k: int = 30) -> DataFrame:
    """a, b, score, label, options, together, expected: the k pairs of forks most likely to be one question, by alike labels, alike option
    words, and never being met together where four meetings would be expected. members: fork, option, run. A score beyond SCORE needs one
    of: the last, or label or options beyond SCORE / (LABEL + OPTIONS); so pairs come from two set joins and from pairs of much reached
    forks that share no run."""
    runs = stored(members.select("fork", "run").dropna().distinct())
    reach = runs.groupBy("fork").agg(F.count("*").alias("r")).filter(F.col("r") >= LEAST_RUNS)
    labels = reach.select("fork", tokens(F.col("fork")).alias("tokens"))
    own = members.join(reach.select("fork"), "fork", "left_semi").select("fork", F.explode(tokens(F.col("option"))).alias("token")).distinct()
    words = own.groupBy("fork").agg(F.collect_set("token").alias("tokens"))
    bound = SCORE / (LABEL + OPTIONS) - 1e-6
    alike = [similar_sets(d, "fork", "tokens", bound).select("a", "b") for d in (labels, words)]
    total = runs.agg(F.countDistinct("run").alias("all_runs"))
    met = runs.select("run", F.col("fork").alias("a")).join(runs.select("run", F.col("fork").alias("b")), "run").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    met = stored(met)
    # reaches of pairs that are expected to meet often: bands of powers of two hold few forks each
    band = F.floor(F.log2("r")).cast("int")
    of = lambda s: reach.select(F.col("fork").alias(s), F.col("r").alias(f"r{s}"))
    banded = reach.crossJoin(F.broadcast(total)).withColumn("band", band)  # one row
    first = F.greatest(F.floor(F.log2(EXPECTED * F.col("all_runs") / F.col("r"))).cast("int"), F.lit(0))
    top = F.floor(F.log2("all_runs")).cast("int")
    wanted = banded.filter(first <= top).select(F.col("fork").alias("a"), F.col("r").alias("ra"), "all_runs", F.explode(F.sequence(first, top)).alias("band"))
    often = wanted.join(banded.select("band", F.col("fork").alias("b"), F.col("r").alias("rb")), "band").filter((F.col("a") < F.col("b")) & (F.col("ra") * F.col("rb") >= EXPECTED * F.col("all_runs")))
    apart = often.select("a", "b").join(met, ["a", "b"], "left_anti")
    pairs = apart.union(alike[0]).union(alike[1]).distinct()
    tok = lambda d, s, n: d.select(F.col("fork").alias(s), F.col("tokens").alias(f"{n}{s}"))
    t = pairs.join(met, ["a", "b"], "left").crossJoin(F.broadcast(total))
    for s in ("a", "b"):
        t = t.join(of(s), s).join(tok(labels, s, "l"), s).join(tok(words, s, "o"), s, "left")
    none = F.array().cast("array<string>")
    together = F.coalesce("together", F.lit(0))
    expected = F.col("ra") * F.col("rb") / F.greatest(F.col("all_runs"), F.lit(1))
    t = t.select("a", "b", text.jaccard(F.col("la"), F.col("lb")).alias("label"), text.jaccard(F.coalesce("oa", none), F.coalesce("ob", none)).alias("options"), together.alias("together"), expected.alias("expected"))
    exclusive = F.when((F.col("together") == 0) & (F.col("expected") >= EXPECTED), EXCLUSIVE).otherwise(0.0)
    t = t.withColumn("score", F.round(LABEL * F.col("label") + OPTIONS * F.col("options") + exclusive, 9)).filter(F.col("score") > SCORE)
    return t.orderBy(F.desc("score"), F.desc("a"), F.desc("b")).limit(k).select("a", "b", "score", F.round("label", 2).alias("label"), F.round("options", 2).alias("options"), "together", F.round("expected", 1).alias("expected"))


def identity(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: neighbouring pairs with a verdict (a, b, same, confidence), those judged one question, their share, and how many of them
    have high confidence."""
    t = pairs.join(verdicts, ["a", "b"]).agg(F.count("*").alias("tested"), F.count(F.when(F.col("same"), 1)).alias("one_question"), F.count(F.when(F.col("same") & (F.col("confidence") == "high"), 1)).alias("high"))
    return t.select("tested", "one_question", F.round(F.col("one_question") / F.greatest(F.col("tested"), F.lit(1)), 6).alias("share"), "high")


def residue_pairs(members: DataFrame, least: float = RESIDUE) -> DataFrame:
    """fork, a, b, similarity: options of one fork that are still alike by words."""
    labels = members.select("fork", "option").dropna().distinct().withColumn("tokens", tokens(F.col("option")))
    return similar_sets(labels, "option", "tokens", least, ("fork",)).select("fork", "a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("similarity"))


def residue(members: DataFrame, least: float = RESIDUE) -> DataFrame:
    """One row: pairs of a fork's options that are alike by words, all such pairs, the share. A floor, not a measure."""
    n = members.select("fork", "option").dropna().distinct().groupBy("fork").agg(F.count("*").alias("n"))
    total = n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))
    t = residue_pairs(members, least).agg(F.count("*").alias("alike")).crossJoin(total)  # one row each
    return t.select("alike", "pairs", F.round(F.col("alike") / F.greatest(F.col("pairs"), F.lit(1)), 6).alias("share"))
