"""Audit checks: PASS, REVIEW or INFO with measurements, and the worst cases as exhibits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASS, REVIEW, INFO = "PASS", "REVIEW", "INFO"


@dataclass
class Check:
    """One check. A REVIEW needs exhibits, a PASS says what it can't see, and a check that uses a signal the result was built from can't
    pass: it informs."""

    name: str
    claim: str
    verdict: str
    measurement: dict[str, float] = field(default_factory=dict)
    blind_to: str = ""
    uses: frozenset[str] = frozenset()
    exhibits: list[dict] = field(default_factory=list)
    shown_of: int = 0


def judged(name: str, claim: str, fine: bool, measurement: dict[str, float], blind_to: str, uses=(), built_from=(), exhibits: DataFrame | None = None, worst=(), show: int = 5) -> Check:
    entangled = bool({*uses} & {*built_from})
    verdict = (INFO if entangled else PASS) if fine else REVIEW
    cases, total = [], 0
    if exhibits is not None and not fine:
        total = exhibits.count()
        cases = [r.asDict() for r in exhibits.orderBy(*worst).limit(show).collect()]
    c = Check(name, claim, verdict, measurement, blind_to, frozenset(uses), cases, total)
    validate(c)
    return c


def validate(c: Check) -> None:
    if c.verdict not in (PASS, REVIEW, INFO):
        raise ValueError(f"{c.name}: no such verdict")
    if c.verdict == REVIEW and not c.exhibits:
        raise ValueError(f"{c.name}: a review needs exhibits")
    if c.verdict == PASS and not c.blind_to:
        raise ValueError(f"{c.name}: a pass says what it is blind to")


def partition_counts(members: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items missing from every group, items in several, groups of one, items per group. members (group, did), items (did)."""
    per = members.groupBy("did").agg(F.count("*").alias("k"))
    groups = members.groupBy("group").agg(F.count("*").alias("n"))
    missing = items.select("did").distinct().join(per, "did", "left_anti").agg(F.count("*").alias("missing"))
    return missing.crossJoin(per.agg(F.sum((F.col("k") > 1).cast("long")).alias("duplicated"))).crossJoin(groups.agg(F.count("*").alias("groups"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.round(F.sum("n") / F.count("*"), 6).alias("compression")))  # one row each


def integrity(members: DataFrame, items: DataFrame, nodes: DataFrame, forks: DataFrame) -> DataFrame:
    """One row: members that are no item, the share of items without group, and forks that only one of two tables has."""
    dangling = members.select("did").distinct().join(items, "did", "left_anti").agg(F.count("*").alias("dangling"))
    loose = items.join(members.select("did").distinct().withColumn("_in", F.lit(1)), "did", "left").agg(F.round(F.avg(F.col("_in").isNull().cast("double")), 6).alias("unassigned"))
    a, b = nodes.select("fork"), forks.select("fork")
    apart = a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("apart"))
    return dangling.crossJoin(loose).crossJoin(apart)  # one row each


def floors(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured (name, value) against limits (name, least): PASS at the floor or above; INFO without a value."""
    return limits.join(measured, "name", "left").withColumn("verdict", F.when(F.col("value").isNull(), INFO).when(F.col("value") >= F.col("least"), PASS).otherwise(REVIEW))


#: The floors of the agreement of two builds.
STABILITY_FLOORS = {"option_ari": 0.85, "fork_ari": 0.75, "b_cubed": 0.80, "lenient_f1": 0.70, "judge": 0.75, "rho": 0.85, "residue": 0.70}
