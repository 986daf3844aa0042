"""What a distilled corpus says about each run: who did what, what the prose leaves out, and where the two differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEGATIVE = ("did_not", "would_have")


def claim_kinds(claims: DataFrame) -> DataFrame:
    """claims (run, id, polarity) with kind: result for what was found, else action."""
    return claims.withColumn("kind", F.when(F.col("polarity") == "found", "result").otherwise("action"))


def presence_grid(decisions: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """Per run: decisions linked, silent and unassessable (a run without prose has none that are silent); action claims that nothing backs,
    of these the consistent negatives (what wasn't done needs no decision) apart; result claims, which wait."""
    d = decisions.join(links.select("run", F.col("decision_id").alias("id"), F.lit(1).alias("l")).distinct(), ["run", "id"], "left").groupBy("run").agg(F.count("*").alias("decisions"), F.count("l").alias("linked"))
    c = claim_kinds(claims).join(links.select("run", F.col("claim_id").alias("id"), F.lit(1).alias("l")).distinct(), ["run", "id"], "left")
    loose, negative = (F.col("kind") == "action") & F.col("l").isNull(), F.coalesce(F.col("polarity").isin(*NEGATIVE), F.lit(False))
    n = lambda x: F.sum(x.cast("long"))
    c = c.groupBy("run").agg(F.count("*").alias("claims"), n(loose & ~negative).alias("unbacked"), n(loose & negative).alias("negatives"), n(F.col("kind") == "result").alias("deferred"))
    z = lambda x: F.coalesce(x, F.lit(0))
    t, prose = d.join(c, "run", "full_outer"), z("claims") > 0
    return t.select("run", z("linked").alias("linked"), F.when(prose, z("decisions") - z("linked")).otherwise(0).alias("silent"), F.when(prose, 0).otherwise(z("decisions")).alias("unassessable"), z("unbacked").alias("unbacked"), z("negatives").alias("negatives"), z("deferred").alias("deferred"))


def misalignments(decisions: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """run, decision, claim, note of links whose sides disagree. decisions (run, id, text), claims (run, id, text)."""
    x = links.filter(F.col("agreement") == "misaligned")
    d, c = decisions.select("run", F.col("id").alias("decision_id"), F.col("text").alias("decision")), claims.select("run", F.col("id").alias("claim_id"), F.col("text").alias("claim"))
    return x.join(d, ["run", "decision_id"]).join(c, ["run", "claim_id"]).select("run", "decision", "claim", "note")


def silent_forks(silent: DataFrame, choice: DataFrame) -> DataFrame:
    """silent (run, text) with the fork of the run's decision of that text, white space around it aside; of several, the last."""
    last = choice.groupBy("run", F.trim("text").alias("text")).agg(F.max_by("fork", "did").alias("fork"))
    return silent.select("run", F.trim("text").alias("text")).join(last, ["run", "text"], "left")


def rollup(grid: DataFrame, links: DataFrame, arms: DataFrame) -> DataFrame:
    """Per arm, and for all (arm null): runs, silent decisions per assessable one, misaligned links per run."""
    m = links.groupBy("run").agg(F.sum((F.col("agreement") == "misaligned").cast("long")).alias("misaligned"))
    t = grid.join(arms, "run").join(m, "run", "left").fillna(0, ["misaligned"])
    out = t.groupingSets([[F.col("arm")], []], "arm").agg(F.count("*").alias("runs"), F.sum("silent").alias("silent"), F.sum(F.col("linked") + F.col("silent")).alias("assessable"), F.sum("misaligned").alias("misaligned"))
    return out.select("arm", "runs", "silent", F.round(F.when(F.col("assessable") > 0, F.col("silent") / F.col("assessable")).otherwise(0.0), 6).alias("silent_share"), F.round(F.col("misaligned") / F.col("runs"), 6).alias("misaligned_per_run"))


def items(decisions: DataFrame, silent: DataFrame, misaligned: DataFrame) -> DataFrame:
    """source, run, text: what a typology can be made of."""
    take = lambda d, source, text: d.select(F.lit(source).alias("source"), "run", F.col(text).alias("text"))
    return take(decisions, "decision", "text").union(take(silent, "silent", "text")).union(take(misaligned, "misaligned", "note"))


def deviations(scores: DataFrame, value: str, flag: str) -> DataFrame:
    """One row: the upper median, the median absolute deviation (1e-9 for 0), and the mean deviation in units of it, of all and of flagged rows."""

    def middle(df: DataFrame, column: str, name: str) -> DataFrame:
        same = df.groupBy(column).agg(F.count("*").alias("k"))  # equal values add up before they are ordered
        n = df.agg(F.count("*").alias("n"))
        up = F.sum("k").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        return same.withColumn("up", up).crossJoin(F.broadcast(n)).filter(F.col("up") > F.floor(F.col("n") / 2)).agg(F.min(column).alias(name))

    t = scores.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(flag).alias("f"))
    t = t.crossJoin(F.broadcast(middle(t, "v", "median"))).withColumn("d", F.abs(F.col("v") - F.col("median")))  # one row
    mad = middle(t, "d", "mad").select(F.when(F.col("mad") > 0, F.col("mad")).otherwise(1e-9).alias("mad"))
    return t.crossJoin(F.broadcast(mad)).agg(F.round(F.first("median"), 6).alias("median"), F.round(F.first("mad"), 6).alias("mad"), F.round(F.avg(F.col("d") / F.col("mad")), 6).alias("every"), F.round(F.avg(F.when(F.col("f"), F.col("d") / F.col("mad"))), 6).alias("flagged"))


def bands(choice: DataFrame, novel: DataFrame, n: int = 5) -> DataFrame:
    """band, decisions, novel, rate: decisions by their place in the run, in n equal bands (the end belongs to the last), and the share of
    them that take a novel option (fork, option)."""
    length = F.max("line").over(Window.partitionBy("run"))
    t = choice.withColumn("band", F.least(F.floor(F.col("line") / length * n), F.lit(n - 1)).cast("long")).join(novel.select("fork", "option", F.lit(1).alias("_new")).distinct(), ["fork", "option"], "left")
    return t.groupBy("band").agg(F.count("*").alias("decisions"), F.count("_new").alias("novel")).withColumn("rate", F.round(F.col("novel") / F.col("decisions"), 6))


def run_rows(choice: DataFrame, silent: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a run for a viewer: its decisions, the lines of silent ones, the forks it visits in order of the first visit, its outcome."""
    first = choice.groupBy("run", "fork").agg(F.min("line").alias("line"))
    visits = first.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "fork"))), lambda x: x["fork"]), ">").alias("forks"))
    quiet = choice.join(silent.select("did").distinct(), "did", "left_semi").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("silent_lines"))
    n = choice.groupBy("run").agg(F.count("*").alias("decisions"))
    return n.join(visits, "run").join(quiet, "run", "left").join(outcomes, "run", "left").fillna("", ["silent_lines"])


def expected_walks(routes: DataFrame) -> DataFrame:
    """Per directed step and arm: runs that walk it, and how many would by the arm's share of all runs."""
    d = routes.select("run", "arm", "a", "b").distinct()
    runs = routes.groupBy("arm").agg(F.countDistinct("run").alias("k"))
    every = runs.agg(F.sum("k").alias("every"))
    n = d.groupBy("a", "b").agg(F.countDistinct("run").alias("n"))
    t = d.groupBy("a", "b", "arm").agg(F.count("*").alias("walked")).join(n, ["a", "b"]).join(runs, "arm").crossJoin(F.broadcast(every))  # one row
    return t.select("a", "b", "arm", "walked", F.round(F.col("n") * F.col("k") / F.col("every"), 6).alias("expected"))
