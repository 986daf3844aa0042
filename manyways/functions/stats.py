"""Statistics as DataFrame expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyways.operators.cluster import stored


def ln_factorial(x: Column) -> Column:
    """ln(x!) for whole x >= 0: a product up to 20, beyond it Stirling's series (exact to about 1e-13)."""
    x = x.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)]), (F.least(F.greatest(x, F.lit(0.0)), F.lit(20.0)) + 1).cast("int"))
    big = F.greatest(x, F.lit(20.0))
    series = (big + 0.5) * F.ln(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big * big * big) + 1 / (1260 * F.pow(big, F.lit(5.0)))
    return F.when(x <= 20, small).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def with_log_factorials(df: DataFrame, **columns: str) -> DataFrame:
    for name, source in columns.items():
        df = df.withColumn(name, ln_factorial(F.col(source)))
    return df


def fisher_tail(df: DataFrame, hit: str, marked: str, hits: str, total: str) -> DataFrame:
    """df and p: the chance of `hit` or more of `hits` among the `marked` of `total` (hypergeometric)."""
    last = F.least(F.col(marked), F.col(hits))
    term = lambda k: F.exp(ln_choose(F.col(marked), k) + ln_choose(F.col(total) - F.col(marked), F.col(hits) - k) - ln_choose(F.col(total), F.col(hits)))
    fits = lambda k: F.col(hits) - k <= F.col(total) - F.col(marked)
    sums = F.aggregate(F.sequence(F.col(hit), last), F.lit(0.0), lambda a, k: a + F.when(fits(k), term(k)).otherwise(F.lit(0.0)))
    return df.withColumn("p", F.least(sums, F.lit(1.0)))


def cumulative(df: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """df with the sum of `weight` over all rows before each in the order of columns that no two rows share. Rows are dealt by ranges of the
    order; each range adds up its own, and the sums of the ranges before it, one number a range, come on top. So no task holds all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("_range").agg(F.sum(weight).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))  # a row a range
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(name, F.coalesce(F.sum(weight).over(own), F.lit(0)))
    return placed.join(F.broadcast(start), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")


def value_counts(df: DataFrame, by: str, *over: str) -> DataFrame:
    """over, by, n, before: how often each value comes in its group, and how many rows of the group have a smaller one. Equal values are
    counted before anything is dealt, so a value that a third of all rows have is one row."""
    counts = df.groupBy(*over, by).agg(F.count("*").alias("n"))
    placed = cumulative(counts, [*over, by], "n", "before")
    if not over:
        return placed
    placed = stored(placed)
    first = placed.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(over))).agg(F.min("before").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(over)]
    return placed.join(first, same).select(*over, by, "n", (F.col("before") - F.col("_first")).alias("before"))


def average_ranks(df: DataFrame, by: str, name: str, *over: str) -> DataFrame:
    """df with ranks from 1 within the groups of `over`; ties share their mean rank, nulls come first."""
    v = value_counts(df, by, *over).withColumn(name, F.col("before") + (F.col("n") + 1) / 2)
    v = v.select(*(F.col(c).alias(f"_v{i}") for i, c in enumerate([*over, by])), name)
    return df.join(v, [F.col(c).eqNullSafe(F.col(f"_v{i}")) for i, c in enumerate([*over, by])]).select(*df.columns, name)


def upper_quantile(df: DataFrame, by: str, q: float = 0.5) -> DataFrame:
    """One row, cut: the value in place floor(n * q) of the sorted ones, counted from 0; null without rows. Null values don't count."""
    v = stored(value_counts(df.filter(F.col(by).isNotNull()), by))
    at = v.agg(F.floor(F.coalesce(F.sum("n"), F.lit(0)) * q).alias("_at"))  # one row
    return v.crossJoin(F.broadcast(at)).agg(F.max(F.when(F.col("before") <= F.col("_at"), F.col(by))).alias("cut"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; 0 where a side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / spread).otherwise(F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, *over: str) -> DataFrame:
    """rho, Pearson's r of average ranks; 0 where it isn't defined."""
    r = average_ranks(average_ranks(df, x, "_x", *over), y, "_y", *over)
    return r.groupBy(*over).agg(F.count("*").alias("n"), F.round(pearson("_x", "_y"), 6).alias("rho"))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """One row: the largest p with p <= q * rank / m, or 0."""
    v = stored(value_counts(df.select(F.col(p).alias("p")).filter("p is not null"), "p"))
    m = v.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"))  # one row
    fine = F.col("p") <= q * (F.col("before") + F.col("n")) / F.col("m")  # the last of equal ones has the highest rank
    most = v.crossJoin(F.broadcast(m)).agg(F.max(F.when(fine, F.col("p"))).alias("most"))
    return m.crossJoin(most).select(F.col("m").alias("tests"), F.coalesce("most", F.lit(0.0)).alias("threshold"))


def rarefaction(counts: DataFrame, group: str, c: str, ks: list[int]) -> DataFrame:
    """Expected number of distinct options among k draws without replacement from each group, exactly; k >= n gives all."""
    n = counts.groupBy(group).agg(F.sum(c).alias("_n"), F.count("*").alias("_options"))
    t = counts.join(n, group).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    missed = F.when(F.col("_n") - F.col(c) < F.col("k"), F.lit(0.0)).otherwise(F.exp(ln_choose(F.col("_n") - F.col(c), F.col("k")) - ln_choose(F.col("_n"), F.col("k"))))
    out = t.groupBy(group, "k").agg(F.max("_n").alias("n"), F.max("_options").alias("options"), F.sum(1 - missed).alias("e"))
    return out.select(group, F.col("k").cast("long").alias("k"), F.round(F.when(F.col("k") >= F.col("n"), F.col("options")).otherwise(F.col("e")), 6).alias("expected"))


def bins(df: DataFrame, by: str, tie: str, n: int = 5) -> DataFrame:
    """df and bin: equal counts in order, the remainder in the last one."""
    placed = cumulative(df.withColumn("_one", F.lit(1).cast("long")), [by, tie], "_one", "_before")
    total = df.agg(F.count("*").alias("_all"))  # one row
    per = F.greatest(F.floor(F.col("_all") / n), F.lit(1))
    return placed.crossJoin(F.broadcast(total)).withColumn("bin", F.least(F.floor(F.col("_before") / per), F.lit(n - 1)).cast("long")).drop("_one", "_before", "_all")
