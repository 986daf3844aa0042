"""Similarity joins of token sets by prefixes in the order of rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room for rounding where a bound on sizes comes from a threshold in floating point.
ROOM = 1e-9


def _ceil(c: Column) -> Column:
    return F.ceil(c - F.lit(ROOM)).cast("int")


def similar_sets(sets: DataFrame, key: str, tokens: str, least: float, within: tuple[str, ...] = ()) -> DataFrame:
    """a < b (keys, of one `within` only) and k, na, nb: shared tokens and sizes of all pairs whose Jaccard similarity is `least` (above 0)
    or more. Tokens are arrays without repeats.

    In an order of all tokens that two alike sets share, rarest first, both have a common token among their first n - ceil(least * n) + 1:
    so only those prefixes meet, at the rarest tokens, and frequent ones are no meeting place at all. Sizes further apart than the
    threshold allows never meet, nor do pairs that could share too few tokens behind the place where they meet. Empty and null sets are
    like none; equal rows count once.
    """
    on = list(within)
    rows = sets.select(*on, F.col(key).alias("key"), F.col(tokens).alias("tokens")).filter(F.size("tokens") > 0).distinct()
    often = rows.select(*on, F.explode("tokens").alias("token")).groupBy(*on, "token").agg(F.count("*").alias("often"))
    ranked = rows.select(*on, "key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(often, [*on, "token"])
    order = F.array_sort(F.collect_list(F.struct("often", "token")))
    sorted_sets = ranked.groupBy(*on, "key", "n").agg(F.transform(order, lambda x: x["token"]).alias("tokens"))
    prefix = sorted_sets.select(*on, "key", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - _ceil(F.col("n") * least) + 1)).alias("place", "token"))
    x, y = (prefix.select(*on, "token", F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("place").alias(f"p{s}")) for s in ("a", "b"))
    # of the tokens from the first meeting on, both have at most the smaller rest in common
    needed = _ceil((F.col("na") + F.col("nb")) * (least / (1 + least)))
    near = (F.col("na") >= _ceil(F.col("nb") * least)) & (F.col("nb") >= _ceil(F.col("na") * least))
    met = x.join(y, [*on, "token"]).filter((F.col("a") < F.col("b")) & near)
    first = met.groupBy(*on, "a", "b", "na", "nb").agg(F.min(F.struct("pa", "pb")).alias("p"))
    fine = first.filter(F.least(F.col("na") - F.col("p.pa"), F.col("nb") - F.col("p.pb")) >= needed).select(*on, "a", "b", "na", "nb")
    of = lambda s: rows.select(*on, F.col("key").alias(s), F.col("tokens").alias(f"t{s}"))
    both = fine.join(of("a"), [*on, "a"]).join(of("b"), [*on, "b"])
    return both.select(*on, "a", "b", F.size(F.array_intersect("ta", "tb")).alias("k"), "na", "nb").filter(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) >= least)
