"""Mixing sources to target weights: a repetition rate per source, and per document floor(rate) copies and a seeded draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyways.llm.common import WORD, table, written

WEIGHTS = (3, 1, 2)
SEEDS = 32
BROADCAST_SOURCES = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame, budget: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """source, source_size -> and target.

    Sources rank by code point, null last; their weights are the given ones in turn. budget times all words are shared by weight,
    a target stops at cap times its source's size, and the excess goes to the others by weight. Taken by rising cap / weight,
    the stopped sources come first, so that running sums give the shares at once.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = per_source.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("top", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.lit(float(budget)) * F.sum("source_size").over(everything))
    before = Window.orderBy(F.col("top") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("rest", F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("stopped", F.col("rest") / F.col("rest_w") * F.col("w") > F.col("top"))
    left = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(everything)
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("top"))).over(everything), F.lit(0.0))) / left
    return ranked.withColumn("target", F.when(F.col("stopped"), F.col("top")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def draw(j: int):
    """The j-th of a document's uniform numbers in [0, 1): double hashing over two parts of the md5 of doc_id."""
    part = lambda at: F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), at, 8), 16, 10).cast("long")
    return F.pmod(part(1) + F.lit(j) * part(9), F.lit(1 << 32)) / F.lit(float(1 << 32))


def rates(sized: DataFrame, budget: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seeds: int = SEEDS) -> DataFrame:
    """its (a source), source_size, target, whole, fraction and seed: what decides on each document's copies. A stored table; broadcast
    if it has at most BROADCAST_SOURCES rows."""
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget, cap, weights)
    per = per.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = written(per.withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole")).withColumnRenamed("source", "its").drop("rate"), "rates")
    small = per.count() <= BROADCAST_SOURCES
    held = lambda df: F.broadcast(df) if small else df
    joined = sized.join(held(per), F.col("source").eqNullSafe(F.col("its")))
    sums = [F.sum(F.when(draw(j) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(seeds)]
    off = F.array(*[F.struct(F.abs(F.col(f"s{j}") - F.col("fraction") * F.col("source_size")).alias("off"), F.lit(j).alias("seed")) for j in range(seeds)])
    chosen = joined.groupBy("its", "source_size", "target", "whole", "fraction").agg(*sums).select("its", "source_size", "target", "whole", "fraction", F.array_min(off)["seed"].alias("seed"))
    return held(written(chosen, "seeds"))


def copied(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows (doc_id, source, ...) with source_size, target and copies: the whole part of the source's rate, and one more by the draw."""
    both = rows.join(per, F.col("source").eqNullSafe(F.col("its")))
    return both.withColumn("copies", (F.col("whole") + (draw(F.col("seed")) < F.col("fraction")).cast("int")).cast("long")).drop("its", "whole", "fraction", "seed")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs; parameters are those of rates().

    Of `seeds` independent hash seeds, each source uses the one whose draws bring its taken words nearest to its target; so a
    source with few, long documents comes near too. A null text has size 0; a null source is a source; a source without words has
    target 0; equal doc_ids (repeated rows) draw alike; an empty table gives an empty result.
    Per-source sums are partial sums first, so a hot source is no hot task. The table of sources is broadcast only if it has at
    most BROADCAST_SOURCES rows; beyond that Spark joins by source.
    """
    sized = written(sizes(docs), "sizes")
    out = copied(sized, rates(sized, **parameters)).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def emit(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed documents: each row of docs as many times as mix() says. A row's source and doc_id decide, so texts aren't shuffled."""
    per = rates(written(sizes(docs), "sizes"), **parameters)
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    return copied(row, per).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int")))).filter("copy > 0").select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS a, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null')), 9, 8))::BIGINT AS b
  FROM documents),
per_source AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 2.0::DOUBLE * source_size AS top, 1.5::DOUBLE * SUM(source_size) OVER () AS total FROM per_source),
weighed AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM ranked),
running AS (
  SELECT *, total - COALESCE(SUM(top) OVER before, 0) AS rest, SUM(w) OVER () - COALESCE(SUM(w) OVER before, 0) AS rest_w FROM weighed
  WINDOW before AS (ORDER BY top / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, rest / rest_w * w > top AS stopped FROM running),
aimed AS (
  SELECT source, source_size, CASE WHEN stopped THEN top ELSE (total - COALESCE(SUM(CASE WHEN stopped THEN top END) OVER (), 0))
    / SUM(CASE WHEN NOT stopped THEN w END) OVER () * w END AS target FROM marked),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed),
rates AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS fraction FROM rated),
tries AS (
  SELECT s.source, j.j, abs(SUM(CASE WHEN ((a + j.j * b) % 4294967296) / 4294967296.0::DOUBLE < fraction THEN size ELSE 0 END) - any_value(fraction * source_size)) AS off
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(32)) AS j) j GROUP BY s.source, j.j),
seeds AS (SELECT source, j FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, j) AS rn FROM tries) WHERE rn = 1)
SELECT s.doc_id, s.size, r.source_size, r.target,
  (size * (whole + CASE WHEN ((a + k.j * b) % 4294967296) / 4294967296.0::DOUBLE < fraction THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN seeds k ON s.source IS NOT DISTINCT FROM k.source
"""
