"""How runs move through stages and forks: returns, transitions, routes, highways, islands. One row order: (line, rank, fork, did)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIE_LINES = 2


def ordered(choice: DataFrame) -> Window:
    return Window.partitionBy("run").orderBy("line", "rank", "fork", "did")


def steps(choice: DataFrame) -> DataFrame:
    """Each decision with the next one of its run: fork, stage rank and line."""
    w = ordered(choice)
    return choice.select("*", F.lead("fork").over(w).alias("to"), F.lead("rank").over(w).alias("to_rank"), F.lead("line").over(w).alias("to_line"))


def returns(choice: DataFrame, tie: int = TIE_LINES) -> DataFrame:
    """Steps back to an earlier stage that are more than `tie` lines away: depth and distance."""
    s = steps(choice).filter((F.col("to_rank") < F.col("rank")) & (F.col("to_line") - F.col("line") > tie))
    return s.select("run", "did", "fork", "to", (F.col("rank") - F.col("to_rank")).cast("long").alias("depth"), (F.col("to_line") - F.col("line")).alias("distance"))


def spaced(choice: DataFrame, gap: int = 3) -> DataFrame:
    """choice with lines `gap` apart, for bindings whose lines are consecutive."""
    return choice.withColumn("line", F.col("line") * gap)


def transitions(choice: DataFrame) -> DataFrame:
    return steps(choice).filter("to is not null").groupBy("fork", "to").agg(F.count("*").alias("n"), F.countDistinct("run").alias("runs"))


def transition_matrix(choice: DataFrame, forks: list[str]) -> DataFrame:
    """transitions as a matrix with one column for each given fork."""
    out = steps(choice).filter("to is not null").groupBy("fork").pivot("to", forks).count()
    return out.select("fork", *[F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(f) for f in forks])


def triggers(choice: DataFrame, least: int = 15) -> DataFrame:
    """Per fork: opportunities (decisions that aren't the last), returns, their rate; forks with `least` opportunities or more."""
    s = steps(choice).filter("to is not null")
    back = (F.col("to_rank") < F.col("rank")) & (F.col("to_line") - F.col("line") > TIE_LINES)
    out = s.groupBy("fork").agg(F.count("*").alias("opportunities"), F.sum(back.cast("long")).alias("returns"))
    return out.filter(F.col("opportunities") >= least).withColumn("rate", F.round(F.col("returns") / F.col("opportunities"), 6))


def returns_by_arm(choice: DataFrame) -> DataFrame:
    """Mean over runs of returns per possible step."""
    back = (F.col("to_rank") < F.col("rank")) & (F.col("to_line") - F.col("line") > TIE_LINES)
    per = steps(choice).groupBy("arm", "run").agg(F.sum(F.coalesce(back, F.lit(False)).cast("long")).alias("r"), F.count("*").alias("n"))
    return per.groupBy("arm").agg(F.count("*").alias("runs"), F.sum("r").alias("returns"), F.round(F.avg(F.col("r") / F.greatest(F.lit(1), F.col("n") - 1)), 6).alias("rate"))


def routes(choice: DataFrame) -> DataFrame:
    """run, arm, a, b: steps between different forks, and one that closes the run (last to first, if they differ)."""
    w = ordered(choice)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = choice.select("run", "arm", "fork", F.lead("fork").over(w).alias("to"), F.first("fork").over(whole).alias("start"))
    return s.select("run", "arm", F.col("fork").alias("a"), F.coalesce("to", "start").alias("b")).filter("a <> b")


def edges(choice: DataFrame) -> DataFrame:
    """Undirected edges per arm: distinct runs that walk them either way."""
    r = routes(choice).select("run", "arm", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return r.groupBy("a", "b", "arm").agg(F.count("*").alias("runs"))


def highways(choice: DataFrame, least: int = 3, k: int = 300) -> DataFrame:
    """Undirected edges with distinct walkers in each direction; kept if one direction has `least`, the k most walked."""
    d = routes(choice).select("run", "a", "b").distinct().withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    out = d.groupBy("x", "y").agg(F.countDistinct("run").alias("n"), F.countDistinct(F.when(F.col("a") == F.col("x"), F.col("run"))).alias("forward"), F.countDistinct(F.when(F.col("a") == F.col("y"), F.col("run"))).alias("backward"))
    return out.filter(F.greatest("forward", "backward") >= least).orderBy(F.desc("n"), "x", "y").limit(k)


def islands(choice: DataFrame, span: int = 5) -> DataFrame:
    """Occurrence number of each decision among its run's at one option: a gap of more than `span` lines starts a new one."""
    w = Window.partitionBy("run", "fork", "option").orderBy("line", "did")
    gap = choice.withColumn("gap", F.coalesce(F.col("line") - F.lag("line").over(w) > span, F.lit(False)))
    return gap.select("did", "run", "fork", "option", F.sum(F.col("gap").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("occurrence"))


def distant(choice: DataFrame, span: int = 5) -> DataFrame:
    """Options at which a run's decisions lie more than `span` lines apart."""
    return choice.groupBy("run", "fork", "option").agg((F.max("line") - F.min("line")).alias("spread"), F.count("*").alias("n")).filter(F.col("spread") > span)


def stratified(items: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """n items, round robin over strata, by key within each."""
    w = Window.partitionBy(stratum).orderBy(key)
    return items.withColumn("round", F.row_number().over(w)).orderBy("round", stratum).limit(n)


def headline(choice: DataFrame, tie: int = TIE_LINES) -> DataFrame:
    """One row: runs, steps, returns, the share of steps that return and of runs that do, mean depth and median distance of returns."""
    r = returns(choice, tie)
    n = steps(choice).filter("to is not null").agg(F.count("*").alias("steps"))
    one = r.agg(F.count("*").alias("returns"), F.countDistinct("run").alias("k"), F.round(F.avg("depth"), 6).alias("depth"), F.median("distance").alias("distance"))
    t = one.crossJoin(n).crossJoin(choice.agg(F.countDistinct("run").alias("runs")))  # one row each
    return t.select("runs", "steps", "returns", F.round(F.col("returns") / F.col("steps"), 6).alias("rate"), F.round(F.col("k") / F.col("runs"), 6).alias("with_return"), "depth", "distance")


def back_pairs(choice: DataFrame, tie: int = TIE_LINES) -> DataFrame:
    """fork, to, n, runs: which fork sends runs back to which."""
    return returns(choice, tie).groupBy("fork", "to").agg(F.count("*").alias("n"), F.countDistinct("run").alias("runs"))
