"""Queries on sequences, pairs, statistics and agreement, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.functions import stats
from manyways.model import CHOICE_SQL, EVENTS_SQL, Query, events_choice, on_events, on_orders, orders_choice, table
from manyways.operators import agreement, forks, pairs, sequence
from manyways.plans.forks_sql import NOVEL, POSITION, STATS

STEPS = """, steps AS (SELECT *, lead(fork) OVER w "to", lead("rank") OVER w to_rank, lead(line) OVER w to_line, first_value(fork) OVER w AS start FROM choice
  WINDOW w AS (PARTITION BY run ORDER BY line, "rank", fork, did))
"""
SPACED = EVENTS_SQL.replace("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line", "3 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line")
ROUTES = STEPS + """, routes AS (SELECT run, arm, fork a, COALESCE("to", start) b FROM steps WHERE fork <> COALESCE("to", start))
"""
TWO = """, items AS (SELECT l_orderkey, p_brand AS a, CASE WHEN p_size <= 20 THEN p_type ELSE 'big' END AS b, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || '/odd' END AS c, l_quantity::BIGINT AS w
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
CELLS = """, cell AS (SELECT {k} a, {b} b, {n}::DOUBLE n FROM items GROUP BY ALL), sa AS (SELECT {k} a, sum(n) na FROM cell GROUP BY ALL), sb AS (SELECT {k} b, sum(n) nb FROM cell GROUP BY ALL)
"""


def builds(spark, sf_dir):
    """Line items under two clusterings a and b, a refinement c of a, and a weight."""
    line, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    b = F.when(F.col("p_size") <= 20, F.col("p_type")).otherwise("big")
    c = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("/odd")))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("a"), b.alias("b"), c.alias("c"), F.col("l_quantity").cast("long").alias("w"))


def on_builds(operator, sql, *args, b="b", **kwargs):
    return Query(lambda s, d: operator(builds(s, d).drop("b").withColumnRenamed("c", "b") if b == "c" else builds(s, d), *args, **kwargs), sql and "WITH " + TWO[2:] + sql)


def spaced(operator, sql, *args, **kwargs):
    return Query(lambda s, d: operator(sequence.spaced(events_choice(s, d)), *args, **kwargs), sql and f"WITH {SPACED}{sql}")


def tokens(spark, sf_dir):
    return orders_choice(spark, sf_dir).select("fork").distinct().select("fork", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("fork"), F.lit("([a-z]+|[0-9]+)")))).alias("token"))


GATES = """, d AS (SELECT DISTINCT fork, option, run FROM choice), rr AS (SELECT DISTINCT fork, run FROM choice), s AS (SELECT fork, count(*) na, any_value(position) AS position FROM rr JOIN position USING (fork) GROUP BY fork HAVING count(*) >= 8),
n AS (SELECT fork a, option, count(*) n1 FROM d GROUP BY ALL), h AS (SELECT d.fork a, d.option, rr.fork b, count(*) hit FROM d JOIN rr ON d.run = rr.run AND d.fork <> rr.fork GROUP BY ALL HAVING count(*) >= 5),
hh AS (SELECT x.fork a, y.fork b, count(*) hits FROM rr x JOIN rr y ON x.run = y.run AND x.fork <> y.fork GROUP BY ALL),
t AS (SELECT a, option, b, hit, hits, n1, na, (hits - hit) / (na - n1) p0, hit / n1 p1 FROM h JOIN hh USING (a, b) JOIN n USING (a, option) JOIN (SELECT fork a, na, position pa FROM s) USING (a) JOIN (SELECT fork b, position pb FROM s) USING (b) WHERE n1 >= 5 AND na - n1 >= 5 AND pb > pa)
"""
BACK = "to_rank < \"rank\" AND to_line - line > 2"
QUERIES = {
    "w2_returns": spaced(sequence.returns, STEPS + f'SELECT run, did, fork, "to", ("rank" - to_rank)::BIGINT depth, to_line - line AS distance FROM steps WHERE {BACK}'),
    "w3_transitions": on_events(sequence.transitions, STEPS + 'SELECT fork, "to", count(*) n, count(DISTINCT run) runs FROM steps WHERE "to" IS NOT NULL GROUP BY ALL'),
    "w3_matrix": on_events(sequence.transition_matrix, STEPS + """SELECT fork, count(*) FILTER ("to" = 'signup') signup, count(*) FILTER ("to" = 'view') AS "view", count(*) FILTER ("to" = 'click') click, count(*) FILTER ("to" = 'purchase') purchase, count(*) FILTER ("to" = 'error') error
        FROM steps WHERE "to" IS NOT NULL GROUP BY fork""", ["signup", "view", "click", "purchase", "error"]),
    "a19_triggers": spaced(sequence.triggers, STEPS + f'SELECT fork, count(*) opportunities, count(*) FILTER ({BACK}) "returns", round(count(*) FILTER ({BACK}) / count(*), 6) rate FROM steps WHERE "to" IS NOT NULL GROUP BY fork HAVING count(*) >= 15'),
    "a19_by_arm": spaced(sequence.returns_by_arm, STEPS + f', per AS (SELECT arm, run, count(*) FILTER ({BACK}) r, count(*) n FROM steps GROUP BY ALL) SELECT arm, count(*) runs, sum(r)::BIGINT "returns", round(avg(r / greatest(1, n - 1)), 6) rate FROM per GROUP BY arm'),
    "w4_routes": on_events(sequence.routes, ROUTES + "SELECT * FROM routes"),
    "w5_edges": on_events(sequence.edges, ROUTES + "SELECT a, b, arm, count(*) runs FROM (SELECT DISTINCT run, arm, least(a, b) a, greatest(a, b) b FROM routes) GROUP BY ALL"),
    "w6_highways": on_events(sequence.highways, ROUTES + """, d AS (SELECT DISTINCT run, a, b, least(a, b) x, greatest(a, b) y FROM routes)
        SELECT x, y, count(DISTINCT run) n, count(DISTINCT run) FILTER (a = x) "forward", count(DISTINCT run) FILTER (a = y) "backward" FROM d GROUP BY ALL HAVING greatest(count(DISTINCT run) FILTER (a = x), count(DISTINCT run) FILTER (a = y)) >= 3"""),
    "w7_islands": on_events(sequence.islands, """, g AS (SELECT *, COALESCE(line - lag(line) OVER w > 5, false)::INT gap FROM choice WINDOW w AS (PARTITION BY run, fork, option ORDER BY line, did))
        SELECT did, run, fork, option, sum(gap) OVER (PARTITION BY run, fork, option ORDER BY line, did ROWS UNBOUNDED PRECEDING)::BIGINT occurrence FROM g"""),
    "w8_distant": on_events(sequence.distant, " SELECT run, fork, option, max(line) - min(line) spread, count(*) n FROM choice GROUP BY ALL HAVING max(line) - min(line) > 5"),
    "w11_stratified": on_events(lambda c: sequence.stratified(c.select("run", "arm").distinct(), "arm", "run", 40).select("run", "arm"), " SELECT run, arm FROM (SELECT run, arm, row_number() OVER (PARTITION BY arm ORDER BY run) rn FROM (SELECT DISTINCT run, arm FROM choice)) ORDER BY rn, arm LIMIT 40"),
    "w10_spearman": on_orders(lambda c: stats.spearman(forks.run_novelty(c), "decisions", "score", "arm"), STATS + NOVEL + """, r AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY decisions) + (count(*) OVER (PARTITION BY arm, decisions) - 1) / 2 x, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 y FROM scores)
        SELECT arm, count(*) n, round(COALESCE(CASE WHEN isnan(corr(x, y)) THEN 0 ELSE corr(x, y) END, 0), 6) rho FROM r GROUP BY arm"""),
    "a17_dose_bins": on_orders(lambda c: stats.bins(forks.run_novelty(c), "score", "run").groupBy("bin").agg(F.count("*").alias("runs"), F.round(F.avg("decisions"), 6).alias("mean")), STATS + NOVEL + """, b AS (SELECT decisions, least(floor((row_number() OVER (ORDER BY score, run) - 1) / greatest(floor(count(*) OVER () / 5), 1)), 4)::BIGINT bin FROM scores)
        SELECT bin, count(*) runs, round(avg(decisions), 6) mean FROM b GROUP BY bin"""),
    "a15_median_split": on_orders(lambda c: _split(forks.run_novelty(c)), STATS + NOVEL + """, m AS (SELECT list_sort(list(score))[(floor(count(*) / 2) + 1)::INT] cut FROM scores)
        SELECT count(*) FILTER (score > cut) high, count(*) FILTER (score <= cut) low, round(avg(decisions) FILTER (score > cut) - avg(decisions) FILTER (score <= cut), 6) difference FROM scores, m"""),
    "a6_rarefaction": on_orders(lambda c: stats.rarefaction(forks.option_runs(c), "fork", "c", [5, 20, 50]), STATS + """, n AS (SELECT fork, sum(c) n, count(*) options FROM option_runs GROUP BY fork), t AS (SELECT fork, c, n, options, k FROM option_runs JOIN n USING (fork) CROSS JOIN (SELECT unnest([5, 20, 50]) k))
        SELECT fork, k::BIGINT k, round(CASE WHEN k >= max(n) THEN max(options) ELSE sum(1 - CASE WHEN n - c < k THEN 0 ELSE exp(lgamma(n - c + 1) - lgamma(n - c - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END) END, 6) expected FROM t GROUP BY fork, k"""),
    "j7_cooccurrence": on_orders(lambda c: pairs.cooccurrence(c, "run", "fork"), ", d AS (SELECT DISTINCT run, fork FROM choice) SELECT x.fork a, y.fork b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL"),
    "g23_jaccard": on_orders(lambda c: pairs.jaccard(c, "run", "fork", 0.05), """, d AS (SELECT DISTINCT run, fork FROM choice), s AS (SELECT fork, count(*) z FROM d GROUP BY fork), p AS (SELECT x.fork a, y.fork b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL)
        SELECT a, b, n, round(n / (s.z + t.z - n), 6) jaccard, round(n / least(s.z, t.z), 6) containment FROM p JOIN s ON s.fork = a JOIN s t ON t.fork = b WHERE round(n / (s.z + t.z - n), 6) >= 0.05"""),
    "g5_exclusive": on_orders(pairs.exclusive, """, d AS (SELECT DISTINCT run, fork FROM choice), s AS (SELECT fork, count(*) z FROM d GROUP BY fork), r AS (SELECT count(DISTINCT run) n FROM choice)
        SELECT s.fork a, t.fork b, round(s.z * t.z / n, 6) expected FROM s JOIN s t ON s.fork < t.fork, r WHERE round(s.z * t.z / n, 6) >= 0.5 AND NOT EXISTS (SELECT 1 FROM d x JOIN d y ON x.run = y.run WHERE x.fork = s.fork AND y.fork = t.fork)""", 0.5),
    "a24_option_clashes": on_orders(pairs.option_clashes, """, d AS (SELECT DISTINCT run, fork, option FROM choice), s AS (SELECT fork, option, count(*) z FROM d GROUP BY ALL), p AS (SELECT x.fork, x.option a, y.option b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork = y.fork AND x.option < y.option GROUP BY ALL)
        SELECT p.fork, a, b, n, round(n / least(s.z, t.z), 6) AS share FROM p JOIN s ON s.fork = p.fork AND s.option = a JOIN s t ON t.fork = p.fork AND t.option = b WHERE round(n / least(s.z, t.z), 6) > 0.25"""),
    "g17_cramers_v": on_orders(pairs.cramers_v, STATS + """, m AS (SELECT * FROM modal JOIN reach USING (fork) WHERE runs >= 100), cell AS (SELECT x.fork a, y.fork b, x.option x, y.option y, count(*) o FROM m x JOIN m y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL),
        t AS (SELECT *, sum(o) OVER (PARTITION BY a, b, x) r, sum(o) OVER (PARTITION BY a, b, y) c, sum(o) OVER (PARTITION BY a, b) n FROM cell)
        SELECT a, b, max(n)::BIGINT runs, round(sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 6) v FROM t GROUP BY a, b HAVING max(n) >= 20 AND least(count(DISTINCT x), count(DISTINCT y)) > 1"""),
    "g12_strongest": on_orders(pairs.strongest, ", d AS (SELECT DISTINCT run, fork || '|' || option o FROM choice) SELECT x.o a, y.o b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.o < y.o GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 60"),
    "a24_exclusivity": on_orders(pairs.exclusivity, """, f AS (SELECT fork, count(DISTINCT option) o, count(DISTINCT run) r FROM choice GROUP BY fork), d AS (SELECT DISTINCT run, fork, option FROM choice), s AS (SELECT fork, option, count(*) z FROM d GROUP BY ALL), p AS (SELECT x.fork, x.option a, y.option b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork = y.fork AND x.option < y.option GROUP BY ALL)
        SELECT (SELECT sum(o * (o - 1) / 2)::BIGINT FROM f) pairs, (SELECT count(*) FROM f WHERE o = 1) orphans, (SELECT median(r) FROM f) median_runs, (SELECT count(*) FROM f WHERE r < 5) small, (SELECT count(*) FROM p JOIN s ON s.fork = p.fork AND s.option = a JOIN s t ON t.fork = p.fork AND t.option = b WHERE round(n / least(s.z, t.z), 6) > 0.25) clashes"""),
    "a19_headline": spaced(sequence.headline, STEPS + f"""SELECT count(DISTINCT run) runs, count(*) FILTER ("to" IS NOT NULL) steps, count(*) FILTER ({BACK}) "returns", round(count(*) FILTER ({BACK}) / count(*) FILTER ("to" IS NOT NULL), 6) rate, round(count(DISTINCT run) FILTER ({BACK}) / count(DISTINCT run), 6) with_return, round(avg("rank" - to_rank) FILTER ({BACK}), 6) AS depth, median(to_line - line) FILTER ({BACK}) AS distance FROM steps"""),
    "a19_back_pairs": spaced(sequence.back_pairs, STEPS + f'SELECT fork, "to", count(*) n, count(DISTINCT run) runs FROM steps WHERE {BACK} GROUP BY ALL'),
    "g4_gate_funnel": on_orders(pairs.gate_funnel, POSITION + GATES + """, o AS (SELECT s.fork, option, count(*) n1, any_value(na) na FROM d JOIN s USING (fork) GROUP BY ALL), f AS (SELECT a.fork, count(*) FILTER (b.fork <> a.fork AND b.position <= a.position) earlier, count(*) - 1 others FROM s a, s b GROUP BY a.fork),
        k AS (SELECT *, CASE WHEN n1 < 5 THEN 'option too rare' WHEN na - n1 < 5 THEN 'no comparison group' ELSE 'fine' END kind FROM o JOIN f USING (fork)),
        r AS (SELECT CASE WHEN p0 > 0.06 THEN 'others reach it too' WHEN p1 < 0.25 THEN 'most don''t reach it' ELSE 'tested' END rule, count(*) n FROM t GROUP BY 1)
        SELECT kind AS rule, count(*) n FROM k WHERE kind <> 'fine' GROUP BY 1 UNION ALL SELECT 'not later', sum(earlier)::BIGINT FROM k WHERE kind = 'fine' HAVING count(*) > 0 UNION ALL SELECT * FROM r
        UNION ALL SELECT 'too few runs', (SELECT COALESCE(sum(others - earlier), 0) FROM k WHERE kind = 'fine')::BIGINT - (SELECT COALESCE(sum(n), 0) FROM r)::BIGINT"""),
    "g4_gates": on_orders(pairs.gates, POSITION + GATES + """, u AS (SELECT *, unnest(range(hit, least(n1, hits) + 1)) k FROM t WHERE p0 <= 0.06 AND p1 >= 0.25),
        v AS (SELECT a, option, b, hit, p0, p1, least(1, sum(CASE WHEN hits - k <= na - n1 THEN exp(lgamma(n1 + 1) - lgamma(k + 1) - lgamma(n1 - k + 1) + lgamma(na - n1 + 1) - lgamma(hits - k + 1) - lgamma(na - n1 - hits + k + 1) - lgamma(na + 1) + lgamma(hits + 1) + lgamma(na - hits + 1)) ELSE 0 END)) p FROM u GROUP BY ALL),
        c AS (SELECT *, row_number() OVER (ORDER BY p) rn, count(*) OVER () m FROM v) SELECT a, option, b, hit, round(p0, 6) p0, round(p1, 6) p1, round(p, 9) p FROM c WHERE p <= (SELECT max(p) FROM c WHERE p <= 0.05 * rn / m)"""),
    "w15_benjamini_hochberg": on_orders(lambda c: stats.benjamini_hochberg(forks.fork_stats(c).withColumn("p", F.round(F.col("modal_share") * F.col("coverage"), 6)), "p", 0.05), STATS + """, r AS (SELECT round(modal_share * coverage, 6) p, row_number() OVER (ORDER BY round(modal_share * coverage, 6)) rn, count(*) OVER () m FROM stats)
        SELECT count(*) tests, COALESCE(max(p) FILTER (p <= 0.05 * rn / m), 0.0) AS threshold FROM r"""),
    "a29_ari": on_builds(agreement.adjusted_rand, CELLS.format(k="", b="b", n="count(*)") + """SELECT t::BIGINT items, round(CASE WHEN (x + y) / 2 = x * y / (t * (t - 1) / 2) THEN 1 ELSE (s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)) END, 6) ari
        FROM (SELECT sum(n * (n - 1) / 2) s, sum(n) t FROM cell), (SELECT sum(na * (na - 1) / 2) x FROM sa), (SELECT sum(nb * (nb - 1) / 2) y FROM sb)"""),
    "a29_ari_refined": on_builds(agreement.adjusted_rand, CELLS.format(k="", b="c", n="count(*)") + """SELECT t::BIGINT items, round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) ari
        FROM (SELECT sum(n * (n - 1) / 2) s, sum(n) t FROM cell), (SELECT sum(na * (na - 1) / 2) x FROM sa), (SELECT sum(nb * (nb - 1) / 2) y FROM sb)""", b="c"),
    "a39_weighted_ari": on_builds(agreement.adjusted_rand, CELLS.format(k="", b="c", n="sum(w)") + """SELECT t::BIGINT items, round((s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) ari
        FROM (SELECT sum(n * (n - 1) / 2) s, sum(n) t FROM cell), (SELECT sum(na * (na - 1) / 2) x FROM sa), (SELECT sum(nb * (nb - 1) / 2) y FROM sb)""", b="c", weight="w"),
    "a34_per_order_ari": on_builds(agreement.adjusted_rand, CELLS.format(k="l_orderkey,", b="b", n="count(*)") + """, m AS (SELECT l_orderkey, s, t, x, y FROM (SELECT l_orderkey, sum(n * (n - 1) / 2) s, sum(n) t FROM cell GROUP BY ALL) JOIN (SELECT l_orderkey, sum(na * (na - 1) / 2) x FROM sa GROUP BY ALL) USING (l_orderkey) JOIN (SELECT l_orderkey, sum(nb * (nb - 1) / 2) y FROM sb GROUP BY ALL) USING (l_orderkey))
        SELECT l_orderkey, t::BIGINT items, round(CASE WHEN t < 2 THEN NULL WHEN (x + y) / 2 = x * y / (t * (t - 1) / 2) THEN 1 ELSE (s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)) END, 6) ari FROM m""", "l_orderkey"),
    "a34_by_size": on_builds(agreement.by_size, CELLS.format(k="l_orderkey,", b="b", n="count(*)") + """, m AS (SELECT l_orderkey, s, t, x, y FROM (SELECT l_orderkey, sum(n * (n - 1) / 2) s, sum(n) t FROM cell GROUP BY ALL) JOIN (SELECT l_orderkey, sum(na * (na - 1) / 2) x FROM sa GROUP BY ALL) USING (l_orderkey) JOIN (SELECT l_orderkey, sum(nb * (nb - 1) / 2) y FROM sb GROUP BY ALL) USING (l_orderkey)),
        r AS (SELECT t, round(CASE WHEN (x + y) / 2 = x * y / (t * (t - 1) / 2) THEN 1 ELSE (s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)) END, 6) ari FROM m WHERE t >= 2) SELECT CASE WHEN t < 4 THEN '<4' WHEN t < 6 THEN '4-5' ELSE '6+' END bucket, count(*) AS "groups", round(avg(ari), 6) mean, round(median(ari), 6) AS median FROM r GROUP BY 1""", "l_orderkey", (4, 6)),
    "a33_verdict": on_builds(agreement.verdict, CELLS.format(k="", b="c", n="count(*)") + """, x AS (SELECT round(sum(n * n / nb) / sum(n), 6) p, round(sum(n * n / na) / sum(n), 6) r, count(DISTINCT a) ka, count(DISTINCT b) kb FROM cell JOIN sa USING (a) JOIN sb USING (b)), y AS (SELECT p, r, ka, kb, CASE WHEN p - r > 0.02 THEN 'finer' WHEN p - r < -0.02 THEN 'coarser' ELSE 'even' END i, CASE WHEN kb > ka THEN 'finer' WHEN kb < ka THEN 'coarser' ELSE 'even' END c FROM x)
        SELECT p AS precision, r recall, ka, kb, i by_items, c by_clusters, CASE WHEN i = c THEN i WHEN i = 'even' THEN c WHEN c = 'even' THEN i ELSE 'ambiguous' END verdict FROM y""", b="c"),
    "a34_pair_recall": on_builds(agreement.pair_recall, CELLS.format(k="", b="c", n="count(*)") + "SELECT round(s / x, 6) a_in_b, round(s / y, 6) b_in_a FROM (SELECT sum(n * (n - 1) / 2) s FROM cell), (SELECT sum(na * (na - 1) / 2) x FROM sa), (SELECT sum(nb * (nb - 1) / 2) y FROM sb)", b="c"),
    "a30_vi": on_builds(agreement.variation_of_information, CELLS.format(k="", b="b", n="count(*)") + ", t AS (SELECT sum(n) t FROM cell) SELECT round(sum(-(n / t) * (log2(n / na) + log2(n / nb))), 6) bits, round(sum(-(n / t) * (log2(n / na) + log2(n / nb))) / log2(any_value(t)), 6) normalised FROM cell JOIN sa USING (a) JOIN sb USING (b), t"),
    "a31_b_cubed": on_builds(agreement.b_cubed, CELLS.format(k="", b="c", n="count(*)") + ", x AS (SELECT sum(n * n / nb) / sum(n) p, sum(n * n / na) / sum(n) r FROM cell JOIN sa USING (a) JOIN sb USING (b)) SELECT round(p, 6) AS precision, round(r, 6) recall, round(2 * p * r / (p + r), 6) f1 FROM x", b="c"),
    "a32_events": on_builds(agreement.events, """, d AS (SELECT DISTINCT a, c AS b FROM items), x AS (SELECT a, count(*) k FROM d GROUP BY a), y AS (SELECT b, count(*) m FROM d GROUP BY b)
        SELECT (SELECT count(*) FROM x WHERE k > 1) split, (SELECT count(*) FROM y WHERE m > 1) merged, (SELECT count(*) FROM d JOIN x USING (a) JOIN y USING (b) WHERE k = 1 AND m = 1) stable""", b="c"),
    "a33_direction": on_builds(agreement.direction, CELLS.format(k="", b="c", n="count(*)") + """, x AS (SELECT round(sum(n * n / nb) / sum(n), 6) p, round(sum(n * n / na) / sum(n), 6) r, count(DISTINCT a) ka, count(DISTINCT b) kb FROM cell JOIN sa USING (a) JOIN sb USING (b))
        SELECT p AS precision, r recall, ka, kb, CASE WHEN p - r > 0.02 THEN 'finer' WHEN p - r < -0.02 THEN 'coarser' ELSE 'even' END by_items, CASE WHEN kb > ka THEN 'finer' WHEN kb < ka THEN 'coarser' ELSE 'even' END by_clusters FROM x""", b="c"),
    "a35_dispersion": on_builds(agreement.dispersion, """, cell AS (SELECT a, b, count(*) n FROM items GROUP BY ALL), r AS (SELECT a, n, row_number() OVER w rk, sum(n) OVER (PARTITION BY a ORDER BY n DESC, b ROWS UNBOUNDED PRECEDING) acc, sum(n) OVER (PARTITION BY a) size FROM cell WINDOW w AS (PARTITION BY a ORDER BY n DESC, b))
        SELECT a, min(rk) clusters, max(size)::BIGINT size, CASE WHEN min(rk) = 1 THEN 'intact' WHEN min(rk) <= 3 THEN 'split' ELSE 'scattered' END kind FROM r WHERE acc >= 0.9 * size GROUP BY a"""),
    "j15_meet": on_builds(agreement.meet, "SELECT a, b, c, count(*) n FROM items GROUP BY ALL", "a", "b", "c"),
}


def _split(scores):
    """Runs above and up to the upper median of score, and the difference of their mean numbers of decisions."""
    cut = stats.upper_quantile(scores, "score")
    t = scores.crossJoin(F.broadcast(cut))  # one row
    high = F.col("score") > F.col("cut")
    return t.agg(F.sum(high.cast("long")).alias("high"), F.sum((~high).cast("long")).alias("low"), F.round(F.avg(F.when(high, F.col("decisions"))) - F.avg(F.when(~high, F.col("decisions"))), 6).alias("difference"))
