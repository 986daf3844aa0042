"""Bindings of fact tables to the core table `choice`: which option each run took at which fork, and where in the run.

choice: did (decision), run, arm, line (place in the run, from 1), fork, option.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are runs, market segments arms, kinds of part forks, brands options."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    fork = F.when(F.col("p_size") <= 20, F.col("p_type")).otherwise(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    place = Window.partitionBy("o_custkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("did"), F.col("o_custkey").alias("run"), F.col("c_mktsegment").alias("arm"),
        F.row_number().over(place).cast("long").alias("line"), fork.alias("fork"), F.col("p_brand").alias("option"),
    )


STAGES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}


def events_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are runs, five arms by user_id, event types forks, bands of value options; with the stage's rank and the time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rank = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("event_type")]
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("event_id").alias("did"), F.col("user_id").alias("run"), F.concat(F.lit("arm"), (F.col("user_id") % 5).cast("string")).alias("arm"), F.row_number().over(place).cast("long").alias("line"),
        F.col("event_type").alias("fork"), F.coalesce(F.floor(F.col("value") / 5).cast("long").cast("string"), F.lit("none")).alias("option"), F.coalesce(rank, F.lit(5)).alias("rank"), "ts",
    )


CHOICE_SQL = """choice AS (
  SELECT l_orderkey * 10 + l_linenumber AS did, o_custkey AS run, c_mktsegment AS arm,
    row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line,
    CASE WHEN p_size <= 20 THEN p_type ELSE p_type || '/' || p_size::VARCHAR END AS fork, p_brand AS option
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""

EVENTS_SQL = """choice AS (
  SELECT event_id AS did, user_id AS run, 'arm' || (user_id % 5)::VARCHAR AS arm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
    event_type AS fork, COALESCE(floor(value / 5)::BIGINT::VARCHAR, 'none') AS option,
    COALESCE(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END, 5) AS rank, ts
  FROM events)"""


@dataclass(frozen=True)
class Query:
    """A query over the driver's tables, and the SQL that must give the same rows."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def over(binding, operator, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(binding(spark, sf_dir), *args, **kwargs)


def on_orders(operator, sql: str | None, *args, **kwargs) -> Query:
    return Query(over(orders_choice, operator, *args, **kwargs), sql and f"WITH {CHOICE_SQL}{sql}")


def on_events(operator, sql: str | None, *args, **kwargs) -> Query:
    return Query(over(events_choice, operator, *args, **kwargs), sql and f"WITH {EVENTS_SQL}{sql}")
