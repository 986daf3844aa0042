"""Queries of rationale clustering: brands stand for the families of a fork's rationales."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.model import CHOICE_SQL, Query, orders_choice
from manyways.operators import rationale


def profile(spark, sf_dir):
    return orders_choice(spark, sf_dir).select("fork", F.col("option").alias("family")).distinct()


def stages(spark, sf_dir):
    return orders_choice(spark, sf_dir).groupBy("fork").agg(F.max("arm").alias("stage"))


def kinds(spark, sf_dir):
    """Each fork in the cluster of its type of part."""
    return profile(spark, sf_dir).select(F.col("fork").alias("id"), F.substring_index("fork", "/", 1).alias("label")).distinct()


PROFILE_SQL = f"WITH {CHOICE_SQL}, p AS (SELECT DISTINCT fork, option AS family FROM choice), l AS (SELECT DISTINCT fork, split_part(fork, '/', 1) AS label FROM p)"

QUERIES = {
    "g19_clusters": Query(lambda s, d: rationale.clusters(profile(s, d), stages(s, d))),  # ties make the tree; tests/test_rationale.py holds it against single merges
    "g19_likeness": Query(lambda s, d: rationale.likeness(rationale.coordinates(profile(s, d))).withColumn("s", F.round("s", 9)), f"""{PROFILE_SQL}, c AS (SELECT fork, family FROM p SEMI JOIN (SELECT family FROM p GROUP BY family HAVING count(*) >= 3) USING (family)), n AS (SELECT fork, count(*) AS n FROM c GROUP BY fork)
        SELECT x.fork AS a, y.fork AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 9) AS s FROM c x JOIN c y ON x.family = y.family AND x.fork < y.fork JOIN n na ON na.fork = x.fork JOIN n nb ON nb.fork = y.fork GROUP BY x.fork, y.fork"""),
    "g19_lift": Query(lambda s, d: rationale.lift(kinds(s, d), profile(s, d)), f"""{PROFILE_SQL}, z AS (SELECT label, count(*) AS n FROM l GROUP BY label), t AS (SELECT label, family, count(*) AS inside FROM p JOIN l USING (fork) GROUP BY ALL),
        e AS (SELECT family, count(*) AS everywhere FROM p GROUP BY family), r AS (SELECT label, family, inside, round(inside / n / (everywhere / (SELECT count(*) FROM l)), 6) AS lift FROM t JOIN z USING (label) JOIN e USING (family) WHERE inside >= greatest(2, 0.3 * n))
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY lift DESC, family DESC)::INTEGER AS rank FROM r"""),
    "g19_silhouettes": Query(lambda s, d: rationale.silhouettes(kinds(s, d).withColumn("k", F.lit(0)), rationale.likeness(profile(s, d))), f"""{PROFILE_SQL}, n AS (SELECT fork, count(*) AS n FROM p GROUP BY fork), k AS (SELECT x.fork AS a, y.fork AS b, count(*) AS k FROM p x JOIN p y USING (family) GROUP BY x.fork, y.fork),
        d AS (SELECT x.fork, y.fork AS other, y.label AS near, 1 - COALESCE(k / (x.n + y.n - k), 0) AS d FROM (l JOIN n USING (fork)) x JOIN (l JOIN n USING (fork)) y ON x.fork <> y.fork LEFT JOIN k ON k.a = x.fork AND k.b = y.fork),
        m AS (SELECT fork, near, avg(d) AS d FROM d GROUP BY ALL), w AS (SELECT label, count(*) AS n FROM l GROUP BY label),
        s AS (SELECT l.fork, w.n, max(m.d) FILTER (near = l.label) AS a, min(m.d) FILTER (near <> l.label) AS b FROM l JOIN m USING (fork) JOIN w USING (label) GROUP BY ALL)
        SELECT 0 AS k, round(avg(CASE WHEN n < 2 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, (SELECT count(*) FROM w) AS clusters, (SELECT max(n) FROM w) AS largest, (SELECT count(*) FILTER (n = 1) FROM w) AS singletons FROM s"""),
}
