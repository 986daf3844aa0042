"""Queries of arbitration: three ways of grouping decisions, each over a part of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.model import CHOICE_SQL, Query, orders_choice
from manyways.operators import arbitration


def decisions(spark, sf_dir):
    """Decisions numbered by run and line, which no two share."""
    return orders_choice(spark, sf_dir).withColumn("did", F.col("run") * 100_000 + F.col("line"))


def three(spark, sf_dir):
    c = decisions(spark, sf_dir)
    kind = F.substring_index("fork", "/", 1)
    return arbitration.shared_labels([
        c.filter("did % 11 <> 0").select("did", F.col("option").alias("label")),
        c.filter("did % 13 <> 0").select("did", F.concat(kind, F.lit(":"), F.substring("option", 7, 1)).alias("label")),
        c.select("did", F.concat(kind, F.lit("."), F.col("option"), F.when(F.col("line") == 3, "!").otherwise("")).alias("label")),
    ])


def options(spark, sf_dir):
    """The options table that three builds agree on; some decisions have no owner."""
    c = decisions(spark, sf_dir)
    oid = F.concat_ws("|", "fork", "option")
    vocabulary = c.select(oid.alias("oid"), "option", "fork").distinct()
    out = arbitration.arbitrated(three(spark, sf_dir), c, c.filter("did % 17 <> 0").select("did", oid.alias("oid")), vocabulary)
    return out.withColumn("arbitrated_from", F.concat_ws(" & ", "arbitrated_from"))


THREE_SQL = f"""{CHOICE_SQL}, s AS (SELECT run * 100000 + line AS did, run, fork || '|' || option AS oid, option AS l1, split_part(fork, '/', 1) || ':' || substr(option, 7, 1) AS l2, split_part(fork, '/', 1) || '.' || option || CASE WHEN line = 3 THEN '!' ELSE '' END AS l3
  FROM choice WHERE (run * 100000 + line) % 11 <> 0 AND (run * 100000 + line) % 13 <> 0), g AS (SELECT l1, l2, l3, count(*) AS n FROM s GROUP BY ALL)"""

QUERIES = {
    "g14_options": Query(options, f"""WITH {THREE_SQL}, w AS (SELECT *, CASE WHEN did % 17 <> 0 THEN oid END AS own FROM s), c AS (SELECT l1, l2, l3, own, count(*) AS k, min(did) AS f FROM w GROUP BY ALL),
        b AS (SELECT l1, l2, l3, own FROM c QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY k DESC, f) = 1), t AS (SELECT l1, l2, l3, count(*) AS n, count(DISTINCT run) AS runs, min(did) AS first_did FROM s GROUP BY ALL)
        SELECT l1 || ' & ' || l2 || ' & ' || l3 AS arbitrated_from, n, runs, first_did, own AS oid, split_part(own, '|', 2) AS option, split_part(own, '|', 1) AS fork FROM t JOIN b USING (l1, l2, l3)"""),
    "g14_report": Query(lambda s, d: arbitration.report(three(s, d)), f"""WITH {THREE_SQL}, p AS (SELECT l1, count(*) AS parts FROM g GROUP BY l1) SELECT (SELECT sum(n) FROM g)::BIGINT AS instances, (SELECT count(*) FROM p) AS clusters_before, (SELECT count(*) FROM g) AS clusters_after,
        (SELECT count(*) FILTER (parts > 1) FROM p) AS disputed, round((SELECT count(*) FILTER (parts > 1) / count(*) FROM p), 6) AS share, (SELECT count(*) FILTER (n = 1) FROM g) AS singletons"""),
    "g14_builds": Query(lambda s, d: arbitration.cluster_counts(three(s, d)), f"WITH {THREE_SQL} SELECT 1 AS build, count(DISTINCT l1) AS clusters FROM s UNION ALL SELECT 2, count(DISTINCT l2) FROM s UNION ALL SELECT 3, count(DISTINCT l3) FROM s"),
}
