"""Human review of pairs: what raters are asked, how far they agree, and what that says about the builds. votes: rater, item, verdict
(same, different or unsure), confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions import text
from manyways.functions.stats import average_ranks, ln_choose
from manyways.operators.setjoin import similar_sets

UNSURE = "unsure"


def item_agreement(votes: DataFrame) -> DataFrame:
    """Per item: pairs of raters, how many of them agree, and the same among raters who committed themselves."""
    n = votes.groupBy("item", "verdict").agg(F.count("*").alias("k"))
    pairs = lambda k: k * (k - 1) / 2
    sure = F.when(F.col("verdict") != UNSURE, F.col("k")).otherwise(0)
    t = n.groupBy("item").agg(F.sum(pairs(F.col("k"))).alias("ok"), F.sum("k").alias("n"), F.sum(pairs(sure)).alias("sure_ok"), F.sum(sure).alias("sure"))
    return t.select("item", pairs(F.col("n")).cast("long").alias("pairs"), F.col("ok").cast("long").alias("agree"), pairs(F.col("sure")).cast("long").alias("sure_pairs"), F.col("sure_ok").cast("long").alias("sure_agree"))


def overall(votes: DataFrame, strata: DataFrame) -> DataFrame:
    """Per stratum (item, stratum): items, and agreement as the mean over items and pooled over pairs, strict and committed."""
    t = item_agreement(votes).join(strata, "item")
    mean = lambda a, b: F.round(F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b))), 6)
    pooled = lambda a, b: F.round(F.sum(a) / F.sum(b), 6)
    return t.groupBy("stratum").agg(F.count("*").alias("items"), mean("agree", "pairs").alias("strict"), mean("sure_agree", "sure_pairs").alias("committed"), pooled("agree", "pairs").alias("strict_pooled"), pooled("sure_agree", "sure_pairs").alias("committed_pooled"))


def by_raters(votes: DataFrame) -> DataFrame:
    """Per pair of raters: items that both judged, and the share on which they agree."""
    x, y = votes.select(F.col("rater").alias("a"), "item", F.col("verdict").alias("va")), votes.select(F.col("rater").alias("b"), "item", F.col("verdict").alias("vb"))
    return x.join(y, "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("items"), F.round(F.avg((F.col("va") == F.col("vb")).cast("double")), 6).alias("agree"))


def rater_z(votes: DataFrame) -> DataFrame:
    """votes with z, the confidence in standard deviations from its rater's mean; 0 for a rater without spread."""
    w = Window.partitionBy("rater")
    sd = F.stddev_samp("confidence").over(w)
    return votes.withColumn("z", F.when(sd > 0, (F.col("confidence") - F.avg("confidence").over(w)) / sd).otherwise(F.lit(0.0)))


def auc(df: DataFrame, score: str, positive: str, *over: str) -> DataFrame:
    """The chance that a positive row scores above a negative one, ties half; null without both."""
    t = average_ranks(df, score, "_r", *over)
    p = F.col(positive).cast("long")
    s = t.groupBy(*over).agg(F.sum(p).alias("p"), F.sum(1 - p).alias("n"), F.sum(F.when(p == 1, F.col("_r"))).alias("r"))
    return s.select(*over, F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))), 6).alias("auc"))


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided p of k out of n at 1/2: all outcomes that are no likelier. Null for n of 0."""
    pmf = lambda i: F.exp(ln_choose(n, i) - n * F.ln(F.lit(2.0)))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), F.lit(0.0), lambda s, i: s + F.when(pmf(i) <= pmf(k) + 1e-12, pmf(i)).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.least(F.lit(1.0), total))


def sound_gold(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """gold (item, want) without items against which half or more of the committed raters voted."""
    t = votes.join(gold, "item").filter(F.col("verdict") != UNSURE).groupBy("item").agg(F.count("*").alias("n"), F.sum((F.col("verdict") != F.col("want")).cast("long")).alias("against"))
    return gold.join(t.filter(F.col("against") * 2 >= F.col("n")).select("item"), "item", "left_anti")


def sound_votes(votes: DataFrame, gold: DataFrame) -> DataFrame:
    """votes of raters who miss none of the sound gold items; who is unsure abstains."""
    missed = votes.join(sound_gold(votes, gold), "item").filter((F.col("verdict") != UNSURE) & (F.col("verdict") != F.col("want"))).select("rater").distinct()
    return votes.join(missed, "rater", "left_anti")


def stable_gap(strata: DataFrame) -> DataFrame:
    """One row: committed agreement (overall()) on items that builds agree on, weighted by items, on the others, and the gap."""
    stable = F.col("stratum").isin("stable_same", "stable_diff")
    t = strata.agg((F.sum(F.when(stable, F.col("committed") * F.col("items"))) / F.sum(F.when(stable, F.col("items")))).alias("s"), F.max(F.when(F.col("stratum") == "unstable", F.col("committed"))).alias("u"))
    return t.select(F.round("s", 6).alias("stable"), F.round("u", 6).alias("unstable"), F.round(F.col("s") - F.col("u"), 6).alias("gap"))


def pool_weighted(strata: DataFrame, pool: DataFrame, model: DataFrame) -> DataFrame:
    """One row: committed agreement and the models' rate (stratum, rate), weighted by how often each stratum occurs (pool: stratum, n). A
    pool that was restricted to pairs some build put together has no models' rate, but the Jaccard index of their pairs."""
    t = pool.join(strata.select("stratum", "committed"), "stratum", "left").join(model, "stratum", "left")
    w = F.when(F.col("committed").isNotNull(), F.col("n"))
    n = lambda s: F.sum(F.when(F.col("stratum") == s, F.col("n")).otherwise(0))
    a = t.agg((F.sum(w * F.col("committed")) / F.sum(w)).alias("h"), (F.sum(w * F.col("rate")) / F.sum(w)).alias("m"), F.sum("n").alias("all"), n("stable_diff").alias("d"), n("unstable").alias("u"), n("stable_same").alias("s"))
    narrow = (F.col("d") / F.col("all") < 0.05) & (F.col("u") > F.col("all") / 2)
    return a.select(F.round("h", 6).alias("human"), narrow.alias("restricted"), F.round(F.when(~narrow, F.col("m")), 6).alias("model"), F.round(F.when(~narrow, F.col("m") - F.col("h")), 6).alias("gap"), F.round(F.when(narrow, F.col("s") / (F.col("s") + F.col("u"))), 6).alias("jaccard"))


def majority(votes: DataFrame) -> DataFrame:
    """item, human: what most committed raters say; items without a majority drop out."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    t = votes.groupBy("item").agg(n("same").alias("s"), n("different").alias("d"))
    return t.filter("s <> d").select("item", F.when(F.col("s") > F.col("d"), "same").otherwise("different").alias("human"))


def against_builds(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Per stratum of items (item, stratum, model_a, model_b: whether the builds say same): majorities, how many agree with each build, the
    exact p of that against chance, and how many contradict both."""
    t = majority(votes).join(items, "item")
    hit = lambda m: F.sum(((F.col("human") == "same") == F.col(m)).cast("long"))
    both = ((F.col("human") == "same") != F.col("model_a")) & ((F.col("human") == "same") != F.col("model_b"))
    s = t.groupBy("stratum").agg(F.count("*").alias("items"), hit("model_a").alias("with_a"), hit("model_b").alias("with_b"), F.sum(both.cast("long")).alias("against_both"))
    return s.select("stratum", "items", "with_a", F.round(binomial_p(F.col("with_a"), F.col("items")), 9).alias("p_a"), "with_b", F.round(binomial_p(F.col("with_b"), F.col("items")), 9).alias("p_b"), "against_both")


def hardest(votes: DataFrame, k: int = 8) -> DataFrame:
    """The k items of greatest difficulty: the share of pairs of committed raters that disagree, less a quarter of the mean z of all raters'
    confidence. Without such a pair an item has none."""
    s = rater_z(votes).groupBy("item").agg(F.count("*").alias("n"), F.avg("z").alias("z")).filter("n >= 2")
    t = s.join(item_agreement(votes).filter("sure_pairs > 0"), "item")
    d = F.round(1 - F.col("sure_agree") / F.col("sure_pairs") - F.col("z") / 4, 6)
    return t.select("item", d.alias("difficulty")).orderBy(F.desc("difficulty"), "item").limit(k)


def unjudgeable(votes: DataFrame) -> DataFrame:
    """Items on which all raters are unsure."""
    return votes.groupBy("item").agg(F.count("*").alias("raters"), F.min((F.col("verdict") == UNSURE).cast("int")).alias("all")).filter("`all` = 1").select("item", "raters")


def remerge_queue(flags: DataFrame, forks: DataFrame) -> DataFrame:
    """fork, instructions, flags, runs, place: forks that reviewers flagged (fork, instruction or null), those with most instructions first,
    then flags, then runs (forks: fork, runs)."""
    t = flags.groupBy("fork").agg(F.count("instruction").alias("instructions"), F.count("*").alias("flags")).join(forks, "fork")
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("instructions"), F.desc("flags"), F.desc("runs"), "fork")))  # flagged forks


def recurring_terms(notes: DataFrame, least: int = 2) -> DataFrame:
    """token, forks: words that reviewers' notes (fork, text) use at several forks."""
    t = notes.select("fork", F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return t.groupBy("token").agg(F.count("*").alias("forks")).filter(F.col("forks") >= least)


def stratum(a: Column, b: Column) -> Column:
    return F.when(a & b, "stable_same").when(~a & ~b, "stable_diff").otherwise("unstable")


def option_pairs(items: DataFrame, ahead: int = 11) -> DataFrame:
    """a, b, stratum of items (item, fork, option_a, option_b) of one fork, each with the `ahead` next ones of the fork's order."""
    t = items.withColumn("_n", F.row_number().over(Window.partitionBy("fork").orderBy("item")))
    y = t.select("fork", F.col("item").alias("b"), F.col("option_a").alias("ya"), F.col("option_b").alias("yb"), (F.col("_n")).alias("_m"))
    x = t.withColumn("_m", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + ahead)))
    return x.join(y, ["fork", "_m"]).select(F.col("item").alias("a"), "b", stratum(F.col("option_a") == F.col("ya"), F.col("option_b") == F.col("yb")).alias("stratum"))


def hard_negatives(options: DataFrame, first: int = 300, least: float = 0.25) -> DataFrame:
    """a, b of the `first` options (at, label_a, label_b: their forks in two builds) whose forks differ in both builds though their names in the
    first share words beyond `least`."""
    t = options.filter(F.col("at") < first).withColumn("w", F.array_except(F.array_distinct(F.split(F.lower("label_a"), r"\s+")), F.array(*map(F.lit, ("the", "a", "is", "are")))))
    e = t.select("at", "label_a", "label_b", "w", F.explode("w").alias("token"))
    pairs = e.select("token", F.col("at").alias("a")).join(e.select("token", F.col("at").alias("b")), "token").filter("a < b").select("a", "b").distinct()
    x, y = (t.select(F.col("at").alias(n), F.col("label_a").alias(f"a{n}"), F.col("label_b").alias(f"b{n}"), F.col("w").alias(f"w{n}")) for n in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").filter((F.col("aa") != F.col("ab")) & (F.col("ba") != F.col("bb")) & (text.jaccard(F.col("wa"), F.col("wb")) > least)).select("a", "b")


def gold_pairs(items: DataFrame, least: float = 0.6) -> DataFrame:
    """option, a, b, jaccard: per option the two items (item, option, words) whose words are most alike, if that is `least` or more."""
    rows = items.filter(F.size("words") > 0).select("option", "item", F.array_sort("words").alias("words")).distinct()
    # copies: the first two of an option's equal sets are its best pair, and others needn't meet
    place = F.row_number().over(Window.partitionBy("option", "words").orderBy("item"))
    first = rows.withColumn("_place", place).filter("_place <= 2").groupBy("option", "words").agg(F.min("item").alias("a"), F.max("item").alias("b"))
    equal = first.filter("a < b").groupBy("option").agg(F.min(F.struct("a", "b")).alias("x")).select("option", "x.a", "x.b", F.lit(1.0).alias("jaccard"))
    t = similar_sets(first.join(equal.select("option"), "option", "left_anti"), "a", "words", least - 1e-6, ("option",))
    t = t.withColumn("jaccard", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6)).filter(F.col("jaccard") >= least)
    best = t.groupBy("option").agg(F.min(F.struct((-F.col("jaccard")).alias("m"), "a", "b")).alias("x")).select("option", "x.a", "x.b", (-F.col("x.m")).alias("jaccard"))
    return equal.union(best)


def worst_and_random(items: DataFrame, n: int, order: Column) -> DataFrame:
    """n items (fork, item, score): half of them the worst of their forks, the worst forks first, half by `order` from the rest."""
    w = Window.partitionBy("fork").orderBy(F.desc("score"), "item")
    worst = items.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc("score"), "item").limit(n // 2)
    rest = items.join(worst.select("item"), "item", "left_anti").orderBy(order, "item").limit(n - n // 2)
    return worst.select("fork", "item", F.lit("worst").alias("drawn")).union(rest.select("fork", "item", F.lit("random").alias("drawn")))


def exhibits(cases: DataFrame, worst: list[Column], show: int = 5) -> DataFrame:
    """cases (check, ...) with the worst of each check first: rank and how many there are (of), `show` of each."""
    w = Window.partitionBy("check")
    t = cases.withColumn("rank", F.row_number().over(w.orderBy(*worst))).withColumn("of", F.count("*").over(w))
    return t.filter(F.col("rank") <= show)
