"""Queries on code against prose, with the SQL that must agree. Customers are runs, market segments corpora; a line item is a decision in code,
in prose, or in both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from manyways.model import Query, table
from manyways.operators import ablation
from manyways.operators.cluster import stored
from manyways.plans.members_sql import tagged

BASE_SQL = """ln AS (SELECT o_custkey run, c_mktsegment corpus, o_custkey * 100000 + row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_discount < 0.08 in_code, l_tax < 0.06 in_prose, l_quantity::BIGINT q, l_returnflag flag, o_custkey % 2 = 0 flipped
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
code AS (SELECT run, corpus, id FROM ln WHERE in_code), prose AS (SELECT run, corpus, -id AS id FROM ln WHERE in_prose),
runs AS (SELECT run, any_value(corpus) corpus, any_value(flipped) flipped, count(*) FILTER (in_code) n_code, count(*) FILTER (in_prose) n_prose FROM ln GROUP BY run HAVING count(*) FILTER (in_code) > 0 AND count(*) FILTER (in_prose) > 0),
pairs AS (SELECT run, flipped, id code_id, -id prose_id, CASE WHEN q % 9 = 0 THEN 'vaguer' WHEN q % 11 = 0 THEN 'same_fork_different_option' ELSE 'same_option' END verdict FROM ln WHERE in_code AND in_prose AND q >= 15 AND run IN (SELECT run FROM runs)),
per AS (SELECT r.*, COALESCE(m, 0) matched, COALESCE(s, 0) same, COALESCE(v, 0) vague, COALESCE(x, 0) conflict, CASE WHEN n_code > 0 THEN COALESCE(m, 0) / n_code ELSE 0 END recall, CASE WHEN COALESCE(m, 0) > 0 THEN s / m ELSE 0 END agree
  FROM runs r LEFT JOIN (SELECT run, count(*) m, count(*) FILTER (verdict = 'same_option') s, count(*) FILTER (verdict = 'vaguer') v, count(*) FILTER (verdict = 'same_fork_different_option') x FROM pairs GROUP BY run) USING (run)),
other AS (SELECT corpus, run, COALESCE(lead(run) OVER (PARTITION BY corpus ORDER BY run), min(run) OVER (PARTITION BY corpus)) AS other FROM runs)
"""
TALLY_SQL = """count(*) runs, sum(n_code)::BIGINT n_code, sum(n_prose)::BIGINT n_prose, sum(matched)::BIGINT matched, round(sum(matched) / sum(n_code), 6) recall, round(sum(same) / sum(matched), 6) strict, round((sum(same) + sum(vague)) / sum(matched), 6) AS lenient,
  round(sum(conflict) / sum(matched), 6) conflict, (sum(n_code) - sum(matched))::BIGINT code_only, (sum(n_prose) - sum(matched))::BIGINT prose_only"""


def lines(spark, sf_dir):
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    t = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return t.select(F.col("o_custkey").alias("run"), F.col("c_mktsegment").alias("corpus"), (F.col("o_custkey") * 100_000 + place).alias("id"), (F.col("l_discount") < 0.08).alias("in_code"), (F.col("l_tax") < 0.06).alias("in_prose"), F.col("l_quantity").cast("long").alias("q"), (F.col("o_custkey") % 2 == 0).alias("flipped"))


def channels(spark, sf_dir):
    t = lines(spark, sf_dir)
    return t.filter("in_code").select("run", "corpus", "id"), t.filter("in_prose").select("run", "corpus", (-F.col("id")).alias("id"))


def runs(spark, sf_dir):
    return ablation.eligible(*channels(spark, sf_dir)).withColumn("flipped", F.col("run") % 2 == 0)


def answers(spark, sf_dir):
    """What a blinded reader answers: flipped runs show prose first."""
    t = lines(spark, sf_dir).filter("in_code and in_prose and q >= 15")
    verdict = F.when(F.col("q") % 9 == 0, "vaguer").when(F.col("q") % 11 == 0, "same_fork_different_option").otherwise("same_option")
    one, two = F.when(F.col("flipped"), -F.col("id")).otherwise(F.col("id")), F.when(F.col("flipped"), F.col("id")).otherwise(-F.col("id"))
    return t.select("run", "flipped", one.alias("id_1"), two.alias("id_2"), verdict.alias("verdict"))


def rows(spark, sf_dir):
    return ablation.per_run(ablation.unblinded(answers(spark, sf_dir)), runs(spark, sf_dir))


def null_rows(spark, sf_dir):
    """Mismatched runs: a tenth of what a run matches with its own prose."""
    t = ablation.unblinded(answers(spark, sf_dir)).filter("abs(code_id) % 10 = 3")
    return ablation.per_run(t, runs(spark, sf_dir))


def with_rest(spark, sf_dir):
    """Answers with what is left unmatched, and some that break the rules."""
    p = ablation.unblinded(answers(spark, sf_dir)).select("run", "code_id", "prose_id", "verdict")
    code, prose = channels(spark, sf_dir)
    left = code.join(p.select("run", F.col("code_id").alias("id")), ["run", "id"], "left_anti").filter("id % 19 <> 0").select("run", F.col("id").alias("code_id"), F.lit(None).cast("long").alias("prose_id"), F.lit(None).cast("string").alias("verdict"))
    right = prose.join(p.select("run", F.col("prose_id").alias("id")), ["run", "id"], "left_anti").select("run", F.lit(None).cast("long").alias("code_id"), F.col("id").alias("prose_id"), F.lit(None).cast("string").alias("verdict"))
    extra = right.filter("prose_id % 29 = 0").union(p.filter("code_id % 31 = 0").select("run", (F.col("code_id") + 5 * 10**11).alias("code_id"), F.lit(None).cast("long").alias("prose_id"), F.lit(None).cast("string").alias("verdict")))
    return p.withColumn("verdict", F.when(F.col("code_id") % 37 == 0, "alike").otherwise(F.col("verdict"))).union(left).union(right).union(extra)


def two_matchings(spark, sf_dir):
    a = ablation.unblinded(answers(spark, sf_dir)).select("run", "code_id", "prose_id", "verdict")
    b = a.filter("code_id % 7 <> 0").withColumn("prose_id", F.when(F.col("code_id") % 5 == 0, F.col("prose_id") - 1).otherwise(F.col("prose_id"))).withColumn("verdict", F.when(F.col("code_id") % 3 == 0, "vaguer").otherwise(F.col("verdict")))
    return a.filter("code_id % 9 <> 0"), b


KIND_SQL = """two AS (SELECT run, code_id, code_id % 9 <> 0 in_a, code_id % 7 <> 0 in_b, code_id % 5 <> 0 same_p, NOT (code_id % 3 = 0 AND verdict <> 'vaguer') same_v FROM pairs0),
kinds AS (SELECT run, code_id, CASE WHEN NOT in_b THEN 'matched_only_in_A' WHEN NOT in_a THEN 'matched_only_in_B' WHEN same_p AND same_v THEN 'identical' WHEN same_p THEN 'verdict_only' WHEN same_v THEN 'partner_only' ELSE 'partner_and_verdict' END kind FROM two WHERE in_a OR in_b)
"""
ALL_PAIRS = "pairs0 AS (SELECT run, id code_id, CASE WHEN q % 9 = 0 THEN 'vaguer' WHEN q % 11 = 0 THEN 'same_fork_different_option' ELSE 'same_option' END verdict FROM ln WHERE in_code AND in_prose AND q >= 15)"


def sql(rest: str) -> str:
    return f"WITH {BASE_SQL}{rest}"


QUERIES = {
    "p10_eligible": Query(lambda s, d: ablation.eligible(*channels(s, d)), sql("SELECT run, corpus, n_code, n_prose FROM runs")),
    "x1_sample": Query(lambda s, d: ablation.sampled(runs(s, d).select("run", "corpus"), 0.25, 300, key=F.col("run") * 7919 % 10007), sql(", k AS (SELECT run, corpus, row_number() OVER (PARTITION BY corpus ORDER BY run * 7919 % 10007, run) rn, count(*) OVER (PARTITION BY corpus) n FROM runs) SELECT run, corpus FROM k WHERE n < 300 OR rn <= greatest(1, round_even(n * 0.25, 0))")),
    "x2_unblinded": Query(lambda s, d: ablation.unblinded(answers(s, d)), sql(f", {ALL_PAIRS} SELECT run, run % 2 = 0 flipped, code_id, -code_id prose_id, verdict FROM pairs0")),
    "x2_answer_errors": Query(lambda s, d: ablation.answer_errors(with_rest(s, d), *channels(s, d)), sql(f""", {ALL_PAIRS}, lc AS (SELECT run, id FROM code WHERE id NOT IN (SELECT code_id FROM pairs0)), lp AS (SELECT run, id FROM prose WHERE id NOT IN (SELECT -code_id FROM pairs0)),
        e AS (SELECT run, 'missing code' problem FROM lc WHERE id % 19 = 0 UNION ALL SELECT run, 'repeated prose' FROM lp WHERE id % 29 = 0 UNION ALL SELECT run, 'unknown code' FROM pairs0 WHERE code_id % 31 = 0 UNION ALL SELECT run, 'verdict' FROM pairs0 WHERE code_id % 37 = 0) SELECT run, problem, count(*) n FROM e GROUP BY ALL""")),
    "j19_null_pairs": Query(lambda s, d: ablation.null_pairs(runs(s, d)), sql("SELECT corpus, run, other FROM other WHERE run <> other")),
    "a26_per_run": Query(lambda s, d: rows(s, d).select("run", "matched", "same", "vague", "conflict", F.round("recall", 6).alias("recall"), F.round("agree", 6).alias("agree")), sql("SELECT run, matched, same, vague, conflict, round(recall, 6) recall, round(agree, 6) agree FROM per")),
    "a26_tally": Query(lambda s, d: ablation.tally(rows(s, d)), sql(f"SELECT corpus, {TALLY_SQL} FROM per GROUP BY GROUPING SETS ((corpus), ())")),
    "a27_audit": Query(lambda s, d: ablation.audited(rows(s, d), null_rows(s, d)), sql(""", z AS (SELECT sum(m)::DOUBLE nm FROM (SELECT count(*) m FROM pairs WHERE code_id % 10 = 3)), o AS (SELECT sum(matched)::DOUBLE m, sum(n_code)::DOUBLE n, avg(flipped::INT) f, max(matched)::DOUBLE most, avg((agree >= 0.85)::INT) FILTER (matched >= 3) clear FROM per),
        k AS (SELECT rank() OVER (ORDER BY n_prose) + (count(*) OVER (PARTITION BY n_prose) - 1) / 2 x, rank() OVER (ORDER BY recall) + (count(*) OVER (PARTITION BY recall) - 1) / 2 y FROM per), r AS (SELECT round(corr(x, y), 6) rho FROM k), w AS (SELECT min(a) worst FROM (SELECT sum(same) / sum(matched) a FROM per GROUP BY corpus))
        SELECT 'E1' AS "check", CASE WHEN f BETWEEN 0.35 AND 0.65 THEN 'PASS' ELSE 'REVIEW' END verdict, round(f, 6) AS value FROM o UNION ALL SELECT 'E2', CASE WHEN nm / n < 0.25 * m / n THEN 'PASS' ELSE 'REVIEW' END, round(nm / n, 6) FROM o, z UNION ALL SELECT 'E3', CASE WHEN abs(rho) < 0.5 THEN 'PASS' ELSE 'REVIEW' END, rho FROM r
        UNION ALL SELECT 'E4', CASE WHEN worst >= 0.85 THEN 'PASS' ELSE 'REVIEW' END, round(worst, 6) FROM w UNION ALL SELECT 'E5', CASE WHEN clear >= 0.6 THEN 'PASS' ELSE 'REVIEW' END, round(clear, 6) FROM o UNION ALL SELECT 'E6', CASE WHEN m / n > 0.05 AND m / n < 0.95 AND most / m < 0.15 THEN 'PASS' ELSE 'REVIEW' END, round(most / m, 6) FROM o""")),
    "a27_quantiles": Query(lambda s, d: ablation.agreement_quantiles(rows(s, d), {"low": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75}), sql(", l AS (SELECT list_sort(list(agree)) a, count(*) n FROM per WHERE matched >= 3) SELECT round(a[1], 6) AS low, round(a[floor(n * 0.25)::INT + 1], 6) q25, round(a[floor(n * 0.5)::INT + 1], 6) AS median, round(a[floor(n * 0.75)::INT + 1], 6) q75 FROM l")),
    "j16_compared": Query(lambda s, d: ablation.compared(*two_matchings(s, d)), sql(f", {ALL_PAIRS}, {KIND_SQL} SELECT * FROM kinds")),
    "j16_stability": Query(lambda s, d: ablation.stability(ablation.compared(*two_matchings(s, d))), sql(f", {ALL_PAIRS}, {KIND_SQL} SELECT count(*) AS \"union\", count(*) FILTER (kind = 'identical') identical, round(count(*) FILTER (kind = 'identical') / count(*) FILTER (NOT starts_with(kind, 'matched_only')), 6) given_both, round(count(*) FILTER (kind = 'identical') / count(*), 6) over_union FROM kinds")),
    "x11_per_kind": Query(lambda s, d: ablation.per_kind(ablation.compared(*two_matchings(s, d)).filter("kind <> 'identical'"), "kind", 60, "code_id", F.col("code_id") * 7919 % 10007), sql(f", {ALL_PAIRS}, {KIND_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY code_id * 7919 % 10007, code_id) rn FROM kinds WHERE kind <> 'identical') SELECT run, code_id, kind FROM k WHERE rn <= floor(60 / (SELECT count(DISTINCT kind) FROM k))")),
    "x6_comparison_kinds": Query(lambda s, d: _kinds(ablation.headers(tagged(s, d))), "SELECT * FROM (VALUES ('a', 'b', 'scope_change'), ('a', 'c', 'input_change'), ('a', 'd', 'replicate'), ('b', 'c', 'scope_change'), ('b', 'd', 'scope_change'), ('c', 'd', 'input_change')) t(a, b, kind)"),
}


def _kinds(h):
    h = stored(h)
    x, y = h.select(F.col("tag").alias("a"), F.struct("*").alias("x")), h.select(F.col("tag").alias("b"), F.struct("*").alias("y"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", ablation.comparison_kind(F.col("x"), F.col("y")).alias("kind"))
