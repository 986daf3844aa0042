"""Spans of lines: partition checks, coverage, matching, presence of decisions in code and prose."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), content: breaks are line feeds only."""
    return docs.select(key, F.posexplode(F.split(text, "\n"))).select(key, (F.col("pos") + 1).cast("long").alias("line"), F.col("col").alias("content"))


def exploded(spans: DataFrame) -> DataFrame:
    """run, id, line of spans (run, id, start, end), ends included."""
    return spans.select("run", "id", F.explode(F.sequence("start", "end")).alias("line"))


def partition_audit(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per run with n lines: lines in no span, in several, and beyond the end."""
    per = exploded(spans).groupBy("run", "line").agg(F.count("*").alias("k"))
    s = sizes.select("run", F.col("n").cast("long").alias("n"))
    t = per.join(s, "run").groupBy("run").agg(F.max("n").alias("n"), F.sum((F.col("line").between(1, F.col("n"))).cast("long")).alias("inside"), F.sum((F.col("k") > 1).cast("long")).alias("shared"), F.sum((~F.col("line").between(1, F.col("n"))).cast("long")).alias("beyond"))
    return s.join(t.drop("n"), "run", "left").select("run", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("gaps"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("beyond", F.lit(0)).alias("beyond"))


def coverage(spans: DataFrame) -> DataFrame:
    """Per run and kind: spans and lines; the kind's share of the run's lines."""
    per = spans.groupBy("run", "kind").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start") + 1).alias("lines"))
    return per.withColumn("share", F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy("run")), 6))


def first_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (run, line, ...) with the id of the first span that covers the line; null without one. An equi-join on covered lines."""
    first = exploded(spans).groupBy("run", "line").agg(F.min("id").alias("span"))
    return points.join(first, ["run", "line"], "left")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of one run that share a line: intersection, Jaccard, containment of the smaller and jitter (symmetric difference)."""
    x, y = (exploded(s) for s in (a, b))
    both = x.withColumnRenamed("id", "i").join(y.withColumnRenamed("id", "j"), ["run", "line"]).groupBy("run", "i", "j").agg(F.count("*").alias("n"))
    na, nb = x.groupBy("run", F.col("id").alias("i")).agg(F.count("*").alias("na")), y.groupBy("run", F.col("id").alias("j")).agg(F.count("*").alias("nb"))
    t = both.join(na, ["run", "i"]).join(nb, ["run", "j"])
    return t.select("run", "i", "j", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"), F.round(F.col("n") / F.least("na", "nb"), 6).alias("containment"), (F.col("na") + F.col("nb") - 2 * F.col("n")).alias("jitter"))


def greedy(pairs: DataFrame, score: str, least: float) -> DataFrame:
    """One-to-one matches within each run: the best score first, ties by i, then j. A run's pairs are one group, as large as its spans."""
    kinds = dict(pairs.dtypes)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "i", "j"], ascending=[False, True, True], kind="stable")
        left, right, keep = set(), set(), []
        for at, (i, j) in enumerate(zip(rows["i"], rows["j"], strict=True)):
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                keep.append(at)
        return rows.iloc[keep]

    rows = pairs.filter(F.col(score) >= least).select("run", "i", "j", F.col(score).alias("s"))
    return rows.groupBy("run").applyInPandas(match, f"run {kinds['run']}, i {kinds['i']}, j {kinds['j']}, s {kinds[score]}").withColumnRenamed("s", score)


def f1(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pooled precision, recall and F1: sums of matches over sums of spans."""
    t = matches.agg(F.count("*").alias("m")).crossJoin(a.agg(F.count("*").alias("a"))).crossJoin(b.agg(F.count("*").alias("b")))  # one row each
    p, r = F.col("m") / F.col("b"), F.col("m") / F.col("a")
    return t.select("m", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(F.col("m") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def silent(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions (run, id) that no claim is linked to."""
    return decisions.join(links.select("run", F.col("decision_id").alias("id")).distinct(), ["run", "id"], "left_anti")


def presence(decisions: DataFrame, claims: DataFrame, links: DataFrame) -> DataFrame:
    """Per run: decisions linked, in code only, unassessable (a run without prose has none that are silent), and claims in prose only."""
    d = decisions.join(links.select("run", F.col("decision_id").alias("id"), F.lit(1).alias("l")).distinct(), ["run", "id"], "left").groupBy("run").agg(F.count("*").alias("decisions"), F.count("l").alias("linked"))
    c = claims.join(links.select("run", F.col("claim_id").alias("id"), F.lit(1).alias("l")).distinct(), ["run", "id"], "left").groupBy("run").agg(F.count("*").alias("claims"), F.count("l").alias("said"))
    t = d.join(c, "run", "full_outer")
    z = lambda n: F.coalesce(n, F.lit(0))
    return t.select("run", z("linked").alias("linked"), F.when(z("claims") > 0, z("decisions") - z("linked")).otherwise(0).alias("code_only"), F.when(z("claims") == 0, z("decisions")).otherwise(0).alias("unassessable"), (z("claims") - z("said")).alias("prose_only"))


def residue(a: DataFrame, b: DataFrame, score: str, least: float = 0.4) -> DataFrame:
    """Per run: silent decisions of two builds (run, id, start, end, words) that match one to one by jaccard or containment of their lines, or by
    the overlap of their words, over all that either has."""
    if score == "text":
        x = a.select("run", F.col("id").alias("i"), F.col("words").alias("x")).join(b.select("run", F.col("id").alias("j"), F.col("words").alias("y")), "run")
        pairs = x.withColumn("text", text_overlap(F.col("x"), F.col("y"))).filter("text is not null")
    else:
        pairs = overlaps(a.select("run", "id", "start", "end"), b.select("run", "id", "start", "end"))
    m = greedy(pairs, score, least).groupBy("run").agg(F.count("*").alias("matched"))
    n = lambda d, name: d.groupBy("run").agg(F.count("*").alias(name))
    t = n(a, "na").join(n(b, "nb"), "run", "full_outer").join(m, "run", "left").fillna(0, ["na", "nb", "matched"])
    union = F.col("na") + F.col("nb") - F.col("matched")
    return t.select("run", "na", "nb", "matched", F.round(F.col("matched") / union, 6).alias("stable"))


def text_overlap(a, b):
    """Jaccard overlap of two arrays of words; null where one has none, as nothing can be said then."""
    from manyways.functions.text import jaccard

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None).cast("double")).otherwise(jaccard(a, b))


def pooled(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: f1() pooled over runs, and how the runs' numbers of spans differ: median and mean of the absolute difference, how many changed."""
    n = lambda d, name: d.groupBy("run").agg(F.count("*").alias(name))
    d = n(a, "x").join(n(b, "y"), "run", "full_outer").fillna(0, ["x", "y"]).withColumn("d", F.abs(F.col("x") - F.col("y")))
    drift = d.agg(F.median("d").alias("median_drift"), F.round(F.avg("d"), 6).alias("mean_drift"), F.sum((F.col("d") > 0).cast("long")).alias("changed"), F.sum((F.col("d") == 0).cast("long")).alias("unchanged"))
    return f1(matches, a, b).crossJoin(drift)  # one row each


def adjudicated(verdicts: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """kind, n: what readers who saw two builds' silent decisions blinded (run, flipped, id_1, id_2, same) found the same, and what only one has
    (a, b: run, id)."""
    x, y = F.when(F.col("flipped"), F.col("id_2")).otherwise(F.col("id_1")), F.when(F.col("flipped"), F.col("id_1")).otherwise(F.col("id_2"))
    same = verdicts.filter("same").select("run", x.alias("i"), y.alias("j"))
    left = a.join(same.select("run", F.col("i").alias("id")), ["run", "id"], "left_anti").agg(F.lit("only_A").alias("kind"), F.count("*").alias("n"))
    right = b.join(same.select("run", F.col("j").alias("id")), ["run", "id"], "left_anti").agg(F.lit("only_B").alias("kind"), F.count("*").alias("n"))
    return same.agg(F.lit("same").alias("kind"), F.count("*").alias("n")).union(left).union(right)


def f1_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, f1() and the share of matches that differ in a line, of spans matched at four levels."""
    from manyways.operators.agreement import LEVELS

    o, out = overlaps(a, b), None
    for level, score, least in LEVELS:
        m = greedy(o, score, least)
        moved = m.join(o.select("run", "i", "j", "jitter"), ["run", "i", "j"]).agg(F.round(F.coalesce(F.avg((F.col("jitter") > 0).cast("double")), F.lit(0.0)), 6).alias("jitter_share"))
        row = f1(m, a, b).crossJoin(moved).withColumn("level", F.lit(level))  # one row each
        out = row if out is None else out.union(row)
    return out


def subtypes(spans: DataFrame, kind: str = "intron") -> DataFrame:
    """run, subtype, lines of one kind of spans (run, kind, subtype, start, end)."""
    return spans.filter(F.col("kind") == kind).groupBy("run", "subtype").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))
