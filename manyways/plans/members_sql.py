"""Queries on members, builds, batches and lineage, with the SQL that must agree."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from manyways.model import CHOICE_SQL, Query, events_choice, on_orders, orders_choice, table
from manyways.operators import members

POINTS_SQL = "pts AS (SELECT DISTINCT 'how ' || substr(option, 1, 7) AS point, option FROM choice UNION SELECT DISTINCT 'why ' || substr(option, 7, 1), option FROM choice WHERE substr(option, 7, 1) < '3')"
TARGETS_SQL = "tg AS (SELECT p_partkey id, p_size::BIGINT line, unnest(string_split(p_name, ' ')) target FROM part)"


#: A decision's number, unique: its run and its line.
NUMBERED_SQL = "num AS (SELECT * REPLACE (run * 100000 + line AS did) FROM choice)"
HANDLE = "fork:" + hashlib.sha1(b"PROMO").hexdigest()[:8]


def numbered(spark, sf_dir):
    return orders_choice(spark, sf_dir).withColumn("did", F.col("run") * 100_000 + F.col("line"))


def options(spark, sf_dir):
    """Options with the decisions that are their members, and two that are none."""
    c = numbered(spark, sf_dir)
    m = F.concat(F.collect_list("did"), F.array(F.lit(-1).cast("long"), F.max("did") + 10**12)).alias("members")
    return c.groupBy("fork", "option").agg(m).withColumn("oid", F.concat_ws("|", "fork", "option"))


def texts(choice):
    return choice.withColumn("text", F.concat_ws(" ", "option", F.lit("is taken here, at line"), F.col("line").cast("string"), F.lit("of the analysis, for this question:"), "fork"))


def two_builds(spark, sf_dir):
    """The same decisions in a second build: some are left out, some read differently at the start (another instance), some at the end."""
    a = texts(numbered(spark, sf_dir))
    b = a.filter("did % 11 <> 0").withColumn("fork", F.substring_index("fork", "/", 1))
    b = b.withColumn("text", F.when(F.col("did") % 13 == 0, F.concat(F.lit("so "), F.col("text"))).when(F.col("did") % 13 == 1, F.concat(F.col("text"), F.lit(" again"))).otherwise(F.col("text")))
    return a, b


def points(choice):
    """Decision points that verdicts put options under; some options are under two."""
    o = choice.select("option").distinct()
    why = o.filter(F.substring("option", 7, 1) < "3").select(F.concat(F.lit("why "), F.substring("option", 7, 1)).alias("point"), "option")
    return o.select(F.concat(F.lit("how "), F.substring("option", 1, 7)).alias("point"), "option").union(why).distinct()


def items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


def verdict_groups(spark, sf_dir):
    """Groups of parts by type; some parts are forgotten, some ids are none."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0")
    return p.select(F.col("p_type").alias("label"), F.when(F.col("p_partkey") % 17 == 0, F.col("p_partkey") + 10**9).otherwise(F.col("p_partkey")).alias("id"))


def targets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("line"), F.explode(F.split("p_name", " ")).alias("target"))


def heads(spark, sf_dir):
    return orders_choice(spark, sf_dir).select("fork", F.substring_index("fork", "/", 1).alias("head")).distinct().filter("head <> 'PROMO'")


def corpora(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return [nation.select(F.col("n_name").alias("name")), region.select(F.col("r_name").alias("name"))]


def questions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    check = F.element_at(F.array(*map(F.lit, ("V1", "V2", "V3", "V4", "V6"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(check.alias("check"), F.col("p_partkey").alias("rank"), F.col("p_name").alias("name"))


def rationale_tags(spark, sf_dir):
    """Tags used at forks, and the families that two batches put some of them in."""
    c = orders_choice(spark, sf_dir)
    used = c.select("fork", F.col("option").alias("tag")).distinct()
    o = c.select(F.col("option").alias("tag")).distinct().filter(F.substring("tag", 8, 1) != "5")
    tags = o.select(F.lit(2).alias("batch"), "tag", F.lit("late").alias("family")).union(o.filter(F.substring("tag", 7, 1) != "4").select(F.lit(1), "tag", F.concat(F.lit("fam"), F.substring("tag", 7, 1))))
    return used, tags


def tagged(spark, sf_dir):
    t = orders_choice(spark, sf_dir).select("did", "run", F.col("arm").alias("corpus"))
    tags = F.array(F.lit("a"), F.when(F.col("corpus") != "BUILDING", "b"), F.when(F.col("did") % 7 != 0, "c"), F.lit("d"))
    return t.withColumn("tag", F.explode(tags)).dropna(subset=["tag"])


QUERIES = {
    "j1_members": Query(lambda s, d: members.exploded(options(s, d), numbered(s, d).select("did", "run", "line")), f"WITH {CHOICE_SQL}, {NUMBERED_SQL} SELECT fork || '|' || option AS oid, fork, option, did, run, line FROM num"),
    "p1_members_per_option": Query(lambda s, d: members.exploded(options(s, d), numbered(s, d).select("did", "run")).groupBy("oid").agg(F.count("*").alias("decisions"), F.countDistinct("run").alias("runs")), f"WITH {CHOICE_SQL} SELECT fork || '|' || option AS oid, count(*) decisions, count(DISTINCT run) runs FROM choice GROUP BY 1"),
    "j14_builds": Query(lambda s, d: members.builds(*two_builds(s, d)), f"WITH {CHOICE_SQL}, {NUMBERED_SQL} SELECT run, line, fork a, split_part(fork, '/', 1) b FROM num WHERE did % 11 <> 0 AND did % 13 <> 0"),
    "p2_relabelled": Query(lambda s, d: members.relabelled(orders_choice(s, d), heads(s, d), False).groupBy("fork").agg(F.count("*").alias("n")), f"WITH {CHOICE_SQL} SELECT CASE WHEN fork LIKE 'PROMO%' THEN fork ELSE split_part(fork, '/', 1) END AS fork, count(*) n FROM choice GROUP BY 1"),
    "p2_induced_stays": Query(lambda s, d: members.relabelled(orders_choice(s, d), heads(s, d), True).groupBy("fork").agg(F.count("*").alias("n")), f"WITH {CHOICE_SQL} SELECT fork, count(*) n FROM choice GROUP BY 1"),
    "g27_backfill": Query(lambda s, d: members.backfilled(verdict_groups(s, d), items(s, d)), "SELECT p_type AS label, p_partkey id, false backfill FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 17 <> 0 UNION ALL SELECT p_name || ' ' || p_type, p_partkey, true FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 17 = 0"),
    "g10_induced": on_orders(lambda c: members.induced(c, points(c)).groupBy("fork", "fork_raw").agg(F.count("*").alias("n")), f", {POINTS_SQL}, f AS (SELECT option, min(point) AS point FROM pts GROUP BY option) SELECT COALESCE(point, fork) AS fork, fork fork_raw, count(*) n FROM choice LEFT JOIN f USING (option) GROUP BY ALL"),
    "g10_co_pairs": on_orders(lambda c: members.co_pairs(c, points(c), 20), f""", {POINTS_SQL}, n AS (SELECT point, count(DISTINCT option) options FROM pts GROUP BY point HAVING count(DISTINCT option) > 1), d AS (SELECT DISTINCT run, point, option FROM choice JOIN pts USING (option)),
        h AS (SELECT point, count(*) hits FROM (SELECT x.point, x.option a, y.option b FROM d x JOIN d y ON x.run = y.run AND x.point = y.point AND x.option < y.option GROUP BY ALL HAVING count(*) >= 20) GROUP BY point)
        SELECT point, options, round(COALESCE(hits, 0) / (options * (options - 1) / 2), 6) AS share, COALESCE(hits, 0) / (options * (options - 1) / 2) > 0.25 flagged FROM n LEFT JOIN h USING (point)"""),
    "u1_union": Query(lambda s, d: members.unioned(corpora(s, d), "name"), "SELECT 0::INT corpus, n_name AS name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation UNION ALL SELECT 1, r_name, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_name) - 1 FROM region"),
    "u4_shared_runs": Query(lambda s, d: members.shared_runs(orders_choice(s, d), events_choice(s, d)), f"WITH {CHOICE_SQL}, e AS (SELECT user_id run FROM events) SELECT DISTINCT run FROM choice WHERE run IN (SELECT run FROM e)"),
    "w13_batches": Query(lambda s, d: members.batches(targets(s, d)), f"""WITH {TARGETS_SQL}, f AS (SELECT target, count(*) freq FROM tg GROUP BY target), r AS (SELECT id, line, target FROM tg JOIN f USING (target) QUALIFY row_number() OVER (PARTITION BY id ORDER BY freq, target) = 1)
        SELECT id, target, floor((row_number() OVER (ORDER BY target, line, id) - 1) / 55)::BIGINT AS batch FROM r"""),
    "w14_merge_order": Query(lambda s, d: members.merge_order(table(s, d, "part").select((F.dense_rank().over(_by("p_partkey")) - 1).alias("i"), "p_name")), "SELECT i, p_name, row_number() OVER (ORDER BY i % 70, i) - 1 AS place FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name FROM part)"),
    "w12_interleaved": Query(lambda s, d: members.interleaved(questions(s, d), ["V2", "V3", "V1", "V4", "V5"]), """SELECT ['V1', 'V2', 'V3', 'V4', 'V6'][p_partkey % 5 + 1] AS "check", p_partkey AS rank, p_name AS name, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) round, [3, 1, 2, 4, 0][p_partkey % 5 + 1] turn FROM part WHERE p_partkey % 5 < 4"""),
    "x33_families": Query(lambda s, d: members.families(*rationale_tags(s, d)), f"WITH {CHOICE_SQL} SELECT DISTINCT fork, CASE WHEN substr(option, 8, 1) = '5' THEN option WHEN substr(option, 7, 1) <> '4' THEN 'fam' || substr(option, 7, 1) ELSE 'late' END AS family FROM choice"),
    "x30_arms": Query(lambda s, d: members.recovered_arms(orders_choice(s, d).select("run", F.when(F.col("run") % 3 != 0, F.col("arm")).alias("arm")).distinct(), orders_choice(s, d).filter("run % 2 = 0").select("run", "arm").distinct()), f"WITH {CHOICE_SQL} SELECT DISTINCT run, CASE WHEN run % 3 <> 0 OR run % 2 = 0 THEN arm ELSE 'unknown' END AS arm FROM choice"),
    "x37_provenance": Query(lambda s, d: members.provenance(orders_choice(s, d), orders_choice(s, d).filter("run % 4 = 1").select("run", F.lit("itinerary").alias("provenance")).distinct()).groupBy("provenance").agg(F.countDistinct("run").alias("runs")), f"WITH {CHOICE_SQL} SELECT CASE WHEN run % 4 = 1 THEN 'itinerary' ELSE 'corpus' END provenance, count(DISTINCT run) runs FROM choice GROUP BY 1"),
    "g28_assigned": Query(lambda s, d: members.assigned(items(s, d).select("id"), table(s, d, "part").filter("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", (F.col("p_size") % 9).cast("string")).alias("category"))), """WITH t AS (SELECT p_partkey id, CASE WHEN p_partkey % 6 <> 0 THEN p_name || (p_size % 9)::VARCHAR ELSE 'NEW' END AS category FROM part) SELECT id, CASE WHEN category = 'NEW' OR count(*) OVER (PARTITION BY category) >= 3 THEN category ELSE 'other' END AS category FROM t"""),
    "g29_trace": on_orders(lambda c: members.traced(c, "promo/2"), " SELECT 'fork:' || substr(sha1(fork), 1, 8) AS handle, fork, option, run, line, did FROM choice WHERE lower(fork) LIKE '%promo/2%'"),
    "g29_trace_handle": on_orders(lambda c: members.traced(c, HANDLE), " SELECT 'fork:' || substr(sha1(fork), 1, 8) AS handle, fork, option, run, line, did FROM choice WHERE fork = 'PROMO'"),
}


def _by(column):
    from pyspark.sql import Window

    return Window.orderBy(column)
