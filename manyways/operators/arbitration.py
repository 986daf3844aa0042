"""Arbitration of several builds of one vocabulary: a merge that any build rejected is undone, and the vocabulary is written anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_labels(builds: list[DataFrame]) -> DataFrame:
    """did, labels: of the decisions that all builds (did, label) have, one label of each, in the order of builds. A decision that a build
    has twice keeps its smallest label there; null decisions and labels don't count."""
    each = [b.select("did", F.col("label").cast("string").alias(f"l{i}")).dropna().groupBy("did").agg(F.min(f"l{i}").alias(f"l{i}")) for i, b in enumerate(builds)]
    return reduce(lambda x, y: x.join(y, "did"), each).select("did", F.array(*[f"l{i}" for i in range(len(builds))]).alias("labels"))


def arbitrated(shared: DataFrame, decisions: DataFrame, owners: DataFrame, options: DataFrame) -> DataFrame:
    """One option for each class of the builds' common refinement: arbitrated_from (its labels), n, runs, first_did, and oid, option, fork of the
    original option (oid, option, fork) that owns the most of its decisions; ties go to the one that owns its first decision. decisions:
    did, run; owners: did, oid, where the largest oid counts if a decision has several. A class that no original option owns most of
    has nulls. Members are rows of shared_labels() under the same labels, never a list."""
    rows = shared.join(decisions.select("did", "run"), "did").join(owners.groupBy("did").agg(F.max("oid").alias("oid")), "did", "left")
    cells = rows.groupBy("labels", "oid").agg(F.count("*").alias("k"), F.min("did").alias("first"))
    largest = cells.groupBy("labels").agg(F.max_by(F.struct("oid"), F.struct("k", -F.col("first"))).alias("x"), F.sum("k").alias("n"), F.min("first").alias("first_did")).select("labels", "x.oid", "n", "first_did")
    runs = rows.select("labels", "run").distinct().groupBy("labels").agg(F.count("run").alias("runs"))
    named = largest.join(runs, "labels").join(options.select("oid", "option", "fork"), "oid", "left")
    return named.select(F.col("labels").alias("arbitrated_from"), "n", "runs", "first_did", "oid", "option", "fork")


def report(shared: DataFrame) -> DataFrame:
    """One row: shared instances, clusters of the first build among them and of the refinement, clusters of the first that others broke up with
    their share, and classes of one decision."""
    groups = shared.groupBy("labels").agg(F.count("*").alias("n"))
    first = groups.groupBy(F.col("labels")[0].alias("first")).agg(F.count("*").alias("parts"))
    t = first.agg(F.count("*").alias("clusters_before"), F.count(F.when(F.col("parts") > 1, 1)).alias("disputed"))
    g = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.count("*").alias("clusters_after"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"))
    return g.crossJoin(t).select("instances", "clusters_before", "clusters_after", "disputed", F.round(F.col("disputed") / F.greatest("clusters_before", F.lit(1)), 6).alias("share"), "singletons")  # one row each


def cluster_counts(shared: DataFrame) -> DataFrame:
    """build (from 1), clusters: of each build, over the shared instances."""
    return shared.select(F.posexplode("labels").alias("build", "label")).distinct().groupBy((F.col("build") + 1).alias("build")).agg(F.count("*").alias("clusters"))
