"""Queries of the lineage audit over kinds of parts, with brute-force SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.model import Query, table
from manyways.operators import lineage

FINISH = ("wide steel", "narrow brass rim", "steel rim", "wide brass", "narrow steel rim", "plain", "plain wide brass")
MEMBERS_SQL = f"""m AS (SELECT l_orderkey * 10 + l_linenumber AS did, o_custkey AS run, p_type || ' ' || split_part(p_name, ' ', 2) || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' choice' ELSE ' fitted choice' END AS fork,
    p_name || ' in ' || [{", ".join(f"'{x}'" for x in FINISH)}][p_size % 7 + 1] AS option, p_brand AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda t: length(t) > 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in lineage.STOP) + ")))"
JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"


def members(spark, sf_dir):
    """did, run, fork, option, text: parts in orders, by type, kind and finish."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "").when(size % 3 == 1, " choice").otherwise(" fitted choice")
    finish = F.element_at(F.array(*map(F.lit, FINISH)), (size % 7 + 1).cast("int"))
    t = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("did"), F.col("o_custkey").alias("run"), F.concat("p_type", F.lit(" "), F.element_at(F.split("p_name", " "), 2), kind).alias("fork"),
        F.concat("p_name", F.lit(" in "), finish).alias("option"), F.col("p_brand").alias("text"),
    )


def checked(spark, sf_dir):
    """Verdicts by the number of members, some against the rules, some missing."""
    shown = lineage.traced(members(spark, sf_dir), forks=1_000_000)
    n = F.col("n_members") % 6
    verdict = F.when(n == 0, "coherent").when(n.isin(1, 3, 5), "impure").when(n == 2, "split")
    rejects = F.when(n.isin(0, 3), F.array()).when(n == 5, F.array(F.lit(14))).otherwise(F.array(F.lit(0), F.lit(2))).cast("array<int>")
    verdicts = shown.select("fork", "option", "n_members").distinct().select("fork", "option", verdict.alias("verdict"), rejects.alias("rejects"), n.alias("n")).filter("n <> 4").drop("n")
    return lineage.checked_purity(shown, verdicts)


CHECKED_SQL = f"""{MEMBERS_SQL}, p AS (SELECT fork, option, count(*) AS n_members FROM m GROUP BY fork, option HAVING count(*) >= 3 QUALIFY row_number() OVER (PARTITION BY fork ORDER BY count(*) DESC, option) <= 3),
  c AS (SELECT fork, option, n_members, least(n_members, 14) AS n_shown, CASE n_members % 6 WHEN 0 THEN 'coherent' WHEN 2 THEN 'split' WHEN 4 THEN NULL ELSE 'impure' END AS verdict,
    CASE n_members % 6 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 5 THEN 1 ELSE 0 END::INTEGER AS n_rejects,
    CASE n_members % 6 WHEN 4 THEN 'unanswered' WHEN 5 THEN 'reject not shown' WHEN 3 THEN 'impure without a reject' END AS fault FROM p)"""


def judged(spark, sf_dir):
    """Neighbours, of which those with a high score are judged one question."""
    pairs = lineage.neighbours(members(spark, sf_dir), 200)
    verdicts = pairs.filter(F.length("a") % 5 != 0).select("a", "b", (F.col("score") > 1.2).alias("same"), F.when(F.length("b") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return lineage.identity(pairs, verdicts)


NEIGHBOURS_SQL = f"""{MEMBERS_SQL}, d AS (SELECT DISTINCT fork, run FROM m), f AS (SELECT fork, count(*) AS r FROM d GROUP BY fork HAVING count(*) >= 4), n AS (SELECT count(DISTINCT run) AS n FROM d),
  w AS (SELECT fork, list(DISTINCT t) AS words FROM (SELECT fork, unnest({TOKENS.format("option")}) AS t FROM (SELECT DISTINCT fork, option FROM m)) GROUP BY fork),
  l AS (SELECT fork, r, {TOKENS.format("fork")} AS label, COALESCE(words, []) AS words FROM f LEFT JOIN w USING (fork)),
  g AS (SELECT x.fork AS a, y.fork AS b, count(*) AS k FROM d x JOIN d y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL),
  s AS (SELECT x.fork AS a, y.fork AS b, {JACCARD.format("x.label", "y.label")} AS lab, {JACCARD.format("x.words", "y.words")} AS opv, COALESCE(k, 0) AS together, x.r * y.r / n AS expected
    FROM l x JOIN l y ON x.fork < y.fork CROSS JOIN n LEFT JOIN g ON g.a = x.fork AND g.b = y.fork),
  t AS (SELECT *, round(1.6 * lab + 1.0 * opv + CASE WHEN together = 0 AND expected >= 4 THEN 0.9 ELSE 0 END, 9) AS score FROM s),
  k AS (SELECT a, b, score, round(lab, 2) AS label, round(opv, 2) AS options, together, round(expected, 1) AS expected FROM t WHERE score > 0.55 ORDER BY score DESC, a DESC, b DESC LIMIT {{0}})"""
RESIDUE_SQL = f"""{MEMBERS_SQL}, o AS (SELECT DISTINCT fork, option, {TOKENS.format("option")} AS t FROM m), p AS (SELECT x.fork, x.option AS a, y.option AS b, {JACCARD.format("x.t", "y.t")} AS j FROM o x JOIN o y ON x.fork = y.fork AND x.option < y.option)"""

QUERIES = {
    "lineage_checked": Query(checked, f"WITH {CHECKED_SQL} SELECT * FROM c"),
    "lineage_purity": Query(lambda s, d: lineage.purity(checked(s, d)), f"""WITH {CHECKED_SQL} SELECT count(*) AS traced, sum(n_shown)::BIGINT AS raw_read, count(*) FILTER (verdict = 'coherent') AS coherent, count(*) FILTER (verdict = 'impure') AS impure, count(*) FILTER (verdict = 'split') AS split, sum(n_rejects)::BIGINT AS rejected,
        round(count(*) FILTER (verdict = 'coherent') / count(*), 6) AS coherent_share, round(count(*) FILTER (verdict = 'impure') / count(*), 6) AS impure_share, round(count(*) FILTER (verdict = 'split') / count(*), 6) AS split_share, round(sum(n_rejects) / sum(n_shown), 6) AS rejected_share FROM c WHERE fault IS NULL"""),
    "lineage_neighbours": Query(lambda s, d: lineage.neighbours(members(s, d), 200), f"WITH {NEIGHBOURS_SQL.format(200)} SELECT * FROM k"),
    "lineage_identity": Query(judged, f"WITH {NEIGHBOURS_SQL.format(200)} SELECT count(*) AS tested, count(*) FILTER (score > 1.2) AS one_question, round(count(*) FILTER (score > 1.2) / count(*), 6) AS share, count(*) FILTER (score > 1.2 AND length(b) % 2 = 0) AS high FROM k WHERE length(a) % 5 <> 0"),
    "lineage_residue_pairs": Query(lambda s, d: lineage.residue_pairs(members(s, d)), f"WITH {RESIDUE_SQL} SELECT fork, a, b, round(j, 6) AS similarity FROM p WHERE j >= 0.6"),
    "lineage_residue": Query(lambda s, d: lineage.residue(members(s, d)), f"WITH {RESIDUE_SQL} SELECT count(*) FILTER (j >= 0.6) AS alike, count(*) AS pairs, round(count(*) FILTER (j >= 0.6) / count(*), 6) AS share FROM p"),
}
