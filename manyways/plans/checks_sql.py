"""Queries on audit sets, screens, nulls and corpus bookkeeping, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.functions import text
from manyways.model import CHOICE_SQL, EVENTS_SQL, Query, events_choice, on_orders, orders_choice, table
from manyways.operators import checks, cluster, forks, pairs, resample, spans, surrogate, tables, trades
from manyways.plans.documents_sql import GRAMS, JACCARD, SPAN_SQL, WORDS, outcome, two_spans
from manyways.plans.forks_sql import STAGE_SQL, STATS, stages
from manyways.plans.projections_sql import TALK_SQL, talk
from manyways.plans.structure_sql import STEPS, builds
from manyways.sources import corpus

LABELLED_SQL = """lab AS (SELECT run, arm, did, line, fork, option || CASE right(option, 1) WHEN '1' THEN ' or none' WHEN '2' THEN ', then log and scale' ELSE '' END AS option FROM choice)"""
SIM = f"greatest({JACCARD.format(WORDS.format('x'), WORDS.format('y'))}, {JACCARD.format(GRAMS.format('lower(x)'), GRAMS.format('lower(y)'))})"
RANKS = {"data": 0, "transformation": 1, "eda": 2, "modeling": 3, "inference": 4, "communication": 5}


def labelled(spark, sf_dir):
    """choice with labels of which some list choices and some are compound."""
    end = F.substring("option", -1, 1)
    return orders_choice(spark, sf_dir).withColumn("option", F.concat("option", F.when(end == "1", " or none").when(end == "2", ", then log and scale").otherwise("")))


def label_tokens(choice):
    return choice.select("fork").distinct().select("fork", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("fork"), F.lit("([a-z]+|[0-9]+)")))).alias("token"))


TOKENS_SQL = "tok AS (SELECT DISTINCT fork, unnest(regexp_extract_all(lower(fork), '([a-z]+|[0-9]+)')) AS token FROM (SELECT DISTINCT fork FROM choice))"


def by_order(spark, sf_dir):
    """Orders as runs: most pairs of forks meet in few of them."""
    return orders_choice(spark, sf_dir).withColumn("run", F.floor(F.col("did") / 10))


def uneven(spark, sf_dir):
    """Events as decisions whose lines are 3, 3 and 0 apart."""
    return events_choice(spark, sf_dir).withColumn("line", F.col("line") * 2 + F.col("line") % 3)


def garden(spark, sf_dir):
    c = orders_choice(spark, sf_dir)
    groups = c.select(F.substring_index("fork", "/", 1).alias("head"), "fork").distinct().filter("head in ('LARGE', 'SMALL') and fork like '%/2%'")
    g = groups.select("head", F.col("fork").alias("a")).join(groups.select("head", F.col("fork").alias("b")), "head").filter("a < b")
    relation = F.when(F.length("a") + F.ascii(F.substring("b", -1, 1)) % 3 == 0, "different").otherwise("sibling")
    return checks.garden(c, label_tokens(c), groups, g.select("a", "b", relation.alias("relation")), forks.with_stage(forks.reach(c), stages(spark, sf_dir)).select("fork", "stage"), pairs.gates(c), RANKS)


def neighbours(spark, sf_dir):
    c = by_order(spark, sf_dir)
    words = c.select("fork", F.col("option").alias("token")).distinct()
    return checks.neighbours(c, label_tokens(c), words, 1.4)


def values(spark, sf_dir):
    c = orders_choice(spark, sf_dir)
    return c.select("did", F.when(F.col("did") % 5 == 0, F.array(F.lit(1.0))).when(F.col("did") % 500 == 1, F.array(F.lit(2.0))).otherwise(F.array().cast("array<double>")).alias("values")).distinct()


def vetoed(spark, sf_dir):
    """Sizes of parts of one type as edges in a line, and some that are known to differ."""
    f = orders_choice(spark, sf_dir).filter("fork like '%/%'").select("fork").distinct()
    x = f.select(F.substring_index("fork", "/", 1).alias("t"), F.substring_index("fork", "/", -1).cast("int").alias("n"), "fork")
    y = x.select("t", F.col("n").alias("m"), F.col("fork").alias("b"))
    e = x.join(y, "t").filter("m - n between 1 and 3")
    return e.select(F.col("fork").alias("a"), "b", (1.0 / (F.col("m") - F.col("n")) + F.col("n") / 1000).alias("score")), e.filter("(n + m) % 11 = 0").select(F.col("fork").alias("a"), "b")


def gate_draws(spark, sf_dir):
    return checks.gate_null(orders_choice(spark, sf_dir), 5)


def contracted(spark, sf_dir):
    b = builds(spark, sf_dir).select("a", F.col("c").alias("b"))
    sizes = lambda c: [r["n"] for r in b.groupBy(F.substring(c, 1, 7).alias("g")).agg(F.count("*").alias("n")).collect()]  # noqa: E731  a handful
    return checks.contraction_null(b, sizes("a"), sizes("b"), 200)


def silent_spans(spark, sf_dir):
    a, b = two_spans(spark, sf_dir)
    words = lambda c: F.filter(F.array(F.lit("fit"), F.concat(F.lit("w"), (F.col(c) % 3).cast("string")), F.when(F.col(c) % 5 == 4, F.lit("log"))), lambda x: x.isNotNull())
    return a.withColumn("words", words("id")), b.withColumn("words", F.when(F.col("id") == 5, F.array().cast("array<string>")).otherwise(words("id")))


def exclusions(spark, sf_dir):
    c = by_order(spark, sf_dir)
    apart = pairs.exclusive(c, 3.0)
    verdicts = apart.filter("length(a) % 2 = 0").select("a", "b", F.lit("rival").alias("relation"))
    return checks.excluded(apart, pairs.jaccard(label_tokens(c), "token", "fork", 0.3), verdicts)


def two_f1(spark, sf_dir):
    a, b = two_spans(spark, sf_dir)
    b = b.filter("run % 4 <> 0 or id < 4")
    return spans.pooled(spans.greedy(spans.overlaps(a, b), "jaccard", 0.5), a, b)


def blinded(spark, sf_dir):
    a, b = two_spans(spark, sf_dir)
    t = a.select("run", "id").join(b.select("run", F.col("id").alias("j")), "run").filter("id = j")
    flipped = F.col("run") % 2 == 0
    v = t.select("run", flipped.alias("flipped"), F.when(flipped, F.col("j")).otherwise(F.col("id")).alias("id_1"), F.when(flipped, F.col("id")).otherwise(F.col("j")).alias("id_2"), ((F.col("run") + F.col("id")) % 3 != 0).alias("same"))
    return spans.adjudicated(v, a.select("run", "id"), b.select("run", "id"))


def manifests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderpriority").alias("root"), (F.col("o_orderstatus") == "F").alias("completed"), F.col("o_orderkey").alias("at"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tag"))
    return corpus.replicates(m, o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("root"), (F.col("o_totalprice") / 100).alias("cost_usd")))


def judged_links(spark, sf_dir):
    _, _, links = talk(spark, sf_dir)
    note = F.when(F.col("claim_id") % 4 == 1, F.concat(F.lit("both agree on "), F.col("note"))).when(F.col("claim_id") % 4 == 3, F.lit(" ")).otherwise(F.col("note"))
    t = links.withColumn("note", note).withColumn("agreement", F.when(F.col("decision_id") % 6 == 4, "unclear").otherwise(F.col("agreement")))
    wrong = F.col("agreement") == "misaligned"
    return corpus.checked(t, ("agreement", F.col("agreement").isin("aligned", "misaligned")), ("empty note", ~wrong | (F.trim("note") != "")), ("concedes", ~wrong | ~text.concedes(F.col("note")))).select("run", "decision_id", "claim_id", "complaint")


def siblings(spark, sf_dir):
    c = by_order(spark, sf_dir)
    return pairs.sibling_screen(c, label_tokens(c), overlap=0.3, options=c.select("fork", "option").distinct(), stages=forks.with_stage(forks.reach(c), stages(spark, sf_dir)).select("fork", "stage"))


QUERIES = {
    "g1_sibling_screen": Query(siblings, f"""WITH {CHOICE_SQL}, {STAGE_SQL}, {TOKENS_SQL}, d AS (SELECT DISTINCT did // 10 AS run, fork FROM choice), r AS (SELECT fork, count(*) z FROM d GROUP BY fork HAVING count(*) >= 8), k AS (SELECT fork, count(*) z FROM tok GROUP BY fork), w AS (SELECT DISTINCT fork, option FROM choice), wk AS (SELECT fork, count(*) z FROM w GROUP BY fork),
        j AS (SELECT x.fork a, y.fork b, count(*) n FROM tok x JOIN tok y ON x.token = y.token AND x.fork < y.fork GROUP BY ALL), o AS (SELECT x.fork a, y.fork b, count(*) n FROM w x JOIN w y ON x.option = y.option AND x.fork < y.fork GROUP BY ALL), co AS (SELECT x.fork a, y.fork b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL),
        l AS (SELECT a, b, round(n / (k.z + q.z - n), 6) jaccard FROM j JOIN k ON k.fork = a JOIN k q ON q.fork = b) SELECT l.a, l.b, jaccard, COALESCE(co.n, 0) shared, round(COALESCE(o.n / (p.z + q.z - o.n), 0), 6) option_overlap, COALESCE(s.stage, 'modeling') = COALESCE(t.stage, 'modeling') same_stage, round(jaccard + greatest(r.z, u.z) / 400, 6) score
        FROM l JOIN r ON r.fork = l.a JOIN r u ON u.fork = l.b LEFT JOIN co ON co.a = l.a AND co.b = l.b LEFT JOIN o ON o.a = l.a AND o.b = l.b JOIN wk p ON p.fork = l.a JOIN wk q ON q.fork = l.b LEFT JOIN st s ON s.fork = l.a LEFT JOIN st t ON t.fork = l.b WHERE jaccard >= 0.3 AND COALESCE(co.n, 0) <= 1"""),
    "audit_vocabulary": Query(lambda s, d: checks.vocabulary(labelled(s, d)), f"""WITH {CHOICE_SQL}, {LABELLED_SQL}, o AS (SELECT DISTINCT fork, option FROM lab), f AS (SELECT fork, count(DISTINCT run) r, count(DISTINCT option) o FROM lab GROUP BY fork), d AS (SELECT DISTINCT run, fork, option FROM lab),
        u AS (SELECT DISTINCT fork AS l FROM lab), v1 AS (SELECT count(*) n FROM (SELECT a.option x, b.option y FROM o a JOIN o b ON a.fork = b.fork AND a.option < b.option) WHERE round({SIM}, 6) >= 0.55), v2 AS (SELECT count(*) n FROM (SELECT DISTINCT a.fork, a.option, b.option FROM d a JOIN d b ON a.run = b.run AND a.fork = b.fork AND a.option < b.option)),
        v3 AS (SELECT count(*) n FROM (SELECT a.l x, b.l y FROM u a JOIN u b ON a.l < b.l) WHERE round({SIM}, 6) >= 0.6), v6 AS (SELECT count(*) n FROM (SELECT 1 FROM lab GROUP BY run, fork, option HAVING max(line) - min(line) > 5)),
        t AS (SELECT 'V1' AS "check", n FROM v1 UNION ALL SELECT 'V2', n FROM v2 UNION ALL SELECT 'V3', n FROM v3 UNION ALL SELECT 'V4', count(*) FROM o WHERE option LIKE '%, then log and scale' UNION ALL SELECT 'V5', count(*) FROM f WHERE r >= 8 AND o / r >= 0.7 UNION ALL SELECT 'V6', n FROM v6 UNION ALL SELECT 'V7', count(*) FROM o WHERE option LIKE '% or none')
        SELECT "check", n::DOUBLE AS value, CASE WHEN n > 0 THEN 'REVIEW' ELSE 'INFO' END verdict FROM t"""),
    "j8_like_options": Query(lambda s, d: checks.alike(labelled(s, d).select("fork", F.col("option").alias("label")), 0.55, "fork"), f"WITH {CHOICE_SQL}, {LABELLED_SQL}, o AS (SELECT DISTINCT fork, option FROM lab), p AS (SELECT a.fork, a.option x, b.option y FROM o a JOIN o b ON a.fork = b.fork AND a.option < b.option) SELECT fork, x a, y b, round({SIM}, 6) similarity FROM p WHERE round({SIM}, 6) >= 0.55"),
    "audit_iteration": Query(lambda s, d: checks.iteration(uneven(s, d)), f"""WITH {EVENTS_SQL}, sp AS (SELECT * REPLACE (line * 2 + line % 3 AS line) FROM choice){STEPS.replace('FROM choice', 'FROM sp')}, z AS (SELECT *, to_rank < "rank" b, to_line - line > 2 a FROM steps WHERE "to" IS NOT NULL), o AS (SELECT count(*) FILTER (b) r, count(*) FILTER (b AND a) k, count(*) n FROM z), tp AS (SELECT max(k) / sum(k) t FROM (SELECT count(*) FILTER (b AND a) k FROM z GROUP BY fork)),
        p AS (SELECT line / max(line) OVER (PARTITION BY run) p, "rank" q FROM sp), rk AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 x, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 y FROM p), rh AS (SELECT corr(x, y) rho FROM rk),
        c3 AS (SELECT run, did, fork, line, CASE WHEN "rank" <= 2 THEN 0 WHEN "rank" <= 4 THEN 1 ELSE 2 END g FROM sp), s3 AS (SELECT run, g, line, lead(g) OVER w tg, lead(line) OVER w tl FROM c3 WINDOW w AS (PARTITION BY run ORDER BY line, g, fork, did)), m AS (SELECT count(DISTINCT run) FILTER (tg < g AND tl - line > 2) / count(DISTINCT run) m FROM s3)
        SELECT 'I1' AS "check", round((r - k) / r, 6) AS value, CASE WHEN (r - k) / r < 0.25 THEN 'PASS' ELSE 'REVIEW' END verdict FROM o UNION ALL SELECT 'I3', round(rho, 6), CASE WHEN rho > 0.25 THEN 'PASS' ELSE 'REVIEW' END FROM rh UNION ALL SELECT 'I4', round(k / n, 6), 'INFO' FROM o
        UNION ALL SELECT 'I5', round(t, 6), CASE WHEN t < 0.25 THEN 'PASS' ELSE 'REVIEW' END FROM tp UNION ALL SELECT 'I6', round(m, 6), CASE WHEN m > 0.5 THEN 'PASS' ELSE 'REVIEW' END FROM m"""),
    "audit_backfill": Query(lambda s, d: checks.clusters(labelled(s, d), values(s, d), orders_choice(s, d).select("did", (F.col("did") % 701 == 0).alias("negated")).distinct(), orders_choice(s, d).filter("did % 97 = 0").select("did")).filter("check = 'backfill'"), f"""WITH {CHOICE_SQL}, r AS (SELECT count(*) FILTER (did % 97 = 0) / count(*) AS r FROM choice)
        SELECT 'backfill' AS "check", round(r, 6) AS value, CASE WHEN r < 0.02 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM r"""),
    "audit_i2": Query(lambda s, d: checks.iteration(uneven(s, d), resample.return_rate_null(uneven(s, d), 200)).filter("check = 'I2'")),
    "audit_clusters": Query(lambda s, d: checks.clusters(labelled(s, d), values(s, d), orders_choice(s, d).select("did", (F.col("did") % 701 == 0).alias("negated")).distinct()), f"""WITH {CHOICE_SQL}, {LABELLED_SQL}, v AS (SELECT DISTINCT fork, option, did % 5 = 0 w FROM lab WHERE did % 5 = 0 OR did % 500 = 1), num AS (SELECT count(*) n FROM (SELECT fork, option FROM v GROUP BY ALL HAVING count(*) > 1)),
        neg AS (SELECT count(*) n FROM (SELECT fork, option FROM lab GROUP BY ALL HAVING count(DISTINCT did % 701 = 0) > 1)), o AS (SELECT DISTINCT fork, option FROM lab), p AS (SELECT a.fork, a.option x, b.option y FROM o a JOIN o b ON a.fork = b.fork AND a.option < b.option), near AS (SELECT count(*) n FROM p WHERE round({SIM}, 6) >= 0.8),
        d AS (SELECT DISTINCT run, fork, option FROM lab), sh AS (SELECT count(*) n FROM (SELECT DISTINCT a.fork, a.option, b.option FROM d a JOIN d b ON a.run = b.run AND a.fork = b.fork AND a.option < b.option)), ex AS (SELECT 1 - (SELECT n FROM sh) / (SELECT count(*) FROM p) n)
        SELECT 'numeric' AS "check", n::DOUBLE AS value, CASE WHEN n = 0 THEN 'PASS' ELSE 'REVIEW' END verdict FROM num UNION ALL SELECT 'negation', n, CASE WHEN n = 0 THEN 'PASS' ELSE 'REVIEW' END FROM neg UNION ALL SELECT 'near', n, CASE WHEN n > 0 THEN 'REVIEW' ELSE 'INFO' END FROM near UNION ALL SELECT 'exclusive', round(n, 6), CASE WHEN n >= 0.9 THEN 'PASS' ELSE 'REVIEW' END FROM ex"""),
    "audit_garden": Query(garden),
    "audit_granularity": Query(lambda s, d: checks.granularity(by_order(s, d), forks.reach(by_order(s, d)).select("fork", (F.col("runs") % 4 + 1).alias("n"))), f"WITH {CHOICE_SQL}, c AS (SELECT did // 10 AS run, fork, option FROM choice), t AS (SELECT fork, count(DISTINCT run) r, count(DISTINCT option) o FROM c GROUP BY fork HAVING count(DISTINCT option) >= 2) SELECT CASE WHEN r <= 4 THEN '2-4' WHEN r <= 9 THEN '5-9' WHEN r <= 29 THEN '10-29' ELSE '30+' END stratum, count(*) forks, sum(o)::BIGINT options, sum(r % 4 + 1)::BIGINT actions, round(sum(r % 4 + 1) / sum(o), 6) ratio FROM t WHERE r >= 2 GROUP BY 1"),
    "g5_neighbours": Query(neighbours, f"""WITH {CHOICE_SQL}, {TOKENS_SQL}, c AS (SELECT DISTINCT did // 10 AS run, fork FROM choice), sz AS (SELECT fork, count(*) z FROM c GROUP BY fork HAVING count(*) >= 4), r AS (SELECT count(DISTINCT run) n FROM c), w AS (SELECT DISTINCT fork, option FROM choice),
        lk AS (SELECT fork, count(*) z FROM tok GROUP BY fork), wk AS (SELECT fork, count(*) z FROM w GROUP BY fork), l AS (SELECT x.fork a, y.fork b, count(*) k FROM tok x JOIN tok y ON x.token = y.token AND x.fork < y.fork GROUP BY ALL), o AS (SELECT x.fork a, y.fork b, count(*) k FROM w x JOIN w y ON x.option = y.option AND x.fork < y.fork GROUP BY ALL),
        co AS (SELECT DISTINCT x.fork a, y.fork b FROM c x JOIN c y ON x.run = y.run AND x.fork < y.fork), p AS (SELECT x.fork a, y.fork b, round(COALESCE(l.k / (p.z + q.z - l.k), 0), 6) j, round(COALESCE(o.k / (m.z + n2.z - o.k), 0), 6) v, CASE WHEN co.a IS NULL AND x.z * y.z >= 4 * n THEN 1 ELSE 0 END e
          FROM sz x JOIN sz y ON x.fork < y.fork CROSS JOIN r JOIN lk p ON p.fork = x.fork JOIN lk q ON q.fork = y.fork JOIN wk m ON m.fork = x.fork JOIN wk n2 ON n2.fork = y.fork LEFT JOIN l ON l.a = x.fork AND l.b = y.fork LEFT JOIN o ON o.a = x.fork AND o.b = y.fork LEFT JOIN co ON co.a = x.fork AND co.b = y.fork)
        SELECT a, b, round(1.6 * j + v + 0.9 * e, 6) score, CASE WHEN j > 0 THEN 'label' WHEN v > 0 THEN 'options' ELSE 'exclusion' END AS source FROM p WHERE round(1.6 * j + v + 0.9 * e, 6) > 1.4"""),
    "g18_exclusions": Query(exclusions, f"""WITH {CHOICE_SQL}, {TOKENS_SQL}, c AS (SELECT DISTINCT did // 10 AS run, fork FROM choice), sz AS (SELECT fork, count(*) z FROM c GROUP BY fork), r AS (SELECT count(DISTINCT run) n FROM c), lk AS (SELECT fork, count(*) z FROM tok GROUP BY fork), l AS (SELECT x.fork a, y.fork b, count(*) k FROM tok x JOIN tok y ON x.token = y.token AND x.fork < y.fork GROUP BY ALL),
        s AS (SELECT a, b FROM l JOIN lk p ON p.fork = a JOIN lk q ON q.fork = b WHERE round(k / (p.z + q.z - k), 6) >= 0.3), e AS (SELECT x.fork a, y.fork b FROM sz x JOIN sz y ON x.fork < y.fork, r WHERE round(x.z * y.z / n, 6) >= 3 AND NOT EXISTS (SELECT 1 FROM c p JOIN c q ON p.run = q.run WHERE p.fork = x.fork AND q.fork = y.fork))
        SELECT e.a, e.b, s.a IS NOT NULL screened, CASE WHEN length(e.a) % 2 = 0 THEN 'rival' ELSE 'not judged' END relation FROM e LEFT JOIN s ON s.a = e.a AND s.b = e.b"""),
    "g22_sectors": on_orders(checks.sectors, STATS + ", w AS (SELECT fork, pow(runs, 0.75) w FROM reach), x AS (SELECT fork, greatest(w / sum(w) OVER (), 0.075 / count(*) OVER ()) x FROM w) SELECT fork, round(x / sum(x) OVER (), 6) width FROM x"),
    "g2_vetoed_groups": Query(lambda s, d: cluster.vetoed_groups(*vetoed(s, d))),
    "g6_dense_groups": Query(lambda s, d: cluster.dense_groups(*vetoed(s, d))),
    "g3_heads": Query(lambda s, d: cluster.head_labels(orders_choice(s, d).select(F.col("fork").alias("id"), F.substring_index("fork", "/", 1).alias("component")).distinct()), f"WITH {CHOICE_SQL} SELECT split_part(fork, '/', 1) component, fork AS head FROM (SELECT DISTINCT fork FROM choice) QUALIFY row_number() OVER (PARTITION BY split_part(fork, '/', 1) ORDER BY length(fork) DESC, fork DESC) = 1"),
    "g8_fold": on_orders(lambda c: cluster.fold(c.groupBy("fork", F.substring("option", 1, 7).alias("option")).agg(F.collect_list("did").alias("members"), F.collect_set("option").alias("option_raw"))).select("fork", "option", F.size("members").alias("n"), F.array_join("option_raw", ",").alias("raw")), " SELECT fork, substr(option, 1, 7) AS option, count(DISTINCT did)::INT n, string_agg(DISTINCT option, ',' ORDER BY option) AS raw FROM choice GROUP BY ALL"),
    "g11_batches": Query(lambda s, d: cluster.nearest_batches(forks.reach(orders_choice(s, d)).withColumnRenamed("fork", "option"), label_tokens(orders_choice(s, d)).withColumnRenamed("fork", "option"))),
    "g16_co_reach": Query(lambda s, d: checks.co_reach(events_choice(s, d), trades.co_occurrence_null(events_choice(s, d), "run", "fork", 1000))),
    "x8_residue_lines": Query(lambda s, d: spans.residue(*silent_spans(s, d), "jaccard"), f"WITH {SPAN_SQL}, o AS (SELECT run, count(*) FILTER (shift <= 3) * 6 k FROM s GROUP BY run, shift) SELECT run, 6::BIGINT na, 6::BIGINT nb, k::BIGINT matched, round(k / (12 - k), 6) stable FROM o"),
    "x8_residue_containment": Query(lambda s, d: spans.residue(*silent_spans(s, d), "containment"), f"WITH {SPAN_SQL}, o AS (SELECT run, CASE WHEN shift <= 4 THEN 6 WHEN shift = 6 THEN 5 ELSE 0 END k, shift FROM s) SELECT run, 6::BIGINT na, 6::BIGINT nb, k::BIGINT matched, round(k / (12 - k), 6) stable FROM o"),
    "x8_residue_text": Query(lambda s, d: spans.residue(*silent_spans(s, d), "text"), f"WITH {SPAN_SQL} SELECT run, 6::BIGINT na, 6::BIGINT nb, 5::BIGINT matched, round(5 / 7, 6) stable FROM s"),
    "x7_pooled": Query(two_f1, f"""WITH {SPAN_SQL}, n AS (SELECT run, shift, CASE WHEN run % 4 <> 0 THEN 6 ELSE 4 END k FROM s), m AS (SELECT sum(CASE WHEN shift <= 2 THEN k ELSE 0 END) m, sum(k) b, 6 * count(*) a, median(6 - k) md, avg(6 - k) mean, count(*) FILTER (k < 6) c, count(*) FILTER (k = 6) u FROM n)
        SELECT m::BIGINT m, round(m / b, 6) AS precision, round(m / a, 6) recall, round(2 * (m / b) * (m / a) / (m / b + m / a), 6) f1, md::DOUBLE median_drift, round(mean, 6) mean_drift, c changed, u unchanged FROM m"""),
    "x10_adjudicated": Query(blinded, f"WITH {SPAN_SQL}, k AS (SELECT (run + id) % 3 <> 0 same FROM a) SELECT 'same' kind, count(*) FILTER (same) n FROM k UNION ALL SELECT 'only_A', count(*) FILTER (NOT same) FROM k UNION ALL SELECT 'only_B', count(*) FILTER (NOT same) FROM k"),
    "x22_replicates": Query(manifests, "WITH t AS (SELECT o_orderpriority root, arg_max('t' || o_orderkey::VARCHAR, o_orderkey) AS tag FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_orderpriority root, round(sum(o_totalprice / 100), 6) cost FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) SELECT root, tag, COALESCE(cost, 0) AS cost FROM t LEFT JOIN c USING (root)"),
    "s14_unanswered": Query(lambda s, d: corpus.unanswered(orders_choice(s, d).select("run", F.col("arm").alias("prompt")).distinct(), orders_choice(s, d).select("run", F.col("arm").alias("prompt"), F.when(F.col("run") % 3 == 0, "old").otherwise("new").alias("prompt_hash")).filter("run % 7 <> 0").distinct(), orders_choice(s, d).select(F.col("arm").alias("prompt"), F.lit("new").alias("prompt_hash")).distinct()), f"WITH {CHOICE_SQL} SELECT DISTINCT run, arm AS prompt FROM choice WHERE run % 7 = 0 OR run % 3 = 0"),
    "x_semantic_checks": Query(judged_links, f"""WITH {TALK_SQL}, k AS (SELECT run, decision_id, claim_id, CASE WHEN decision_id % 6 = 4 THEN 'unclear' ELSE agreement END g FROM ll) SELECT run, decision_id, claim_id, CASE WHEN g = 'unclear' THEN 'agreement' WHEN g = 'misaligned' AND claim_id % 4 = 3 THEN 'empty note' WHEN g = 'misaligned' AND claim_id % 4 = 1 THEN 'concedes' END complaint FROM k"""),
    "m2_novelty_player": Query(lambda s, d: surrogate.novelty_player(orders_choice(s, d).groupBy("run").agg((F.count("*") % 10 / 10).alias("score"))), f"""WITH {CHOICE_SQL}, scores AS (SELECT run, count(*) % 10 / 10 AS score FROM choice GROUP BY run), v AS (SELECT list_sort(list(score)) l, count(*) n FROM scores WHERE score > 0), k AS (SELECT l[(n // 3) + 1] lo, l[(2 * n // 3) + 1] hi, n FROM v),
        t AS (SELECT run, 'novelty' AS fork, CASE WHEN score <= 0 THEN 'no novel options' WHEN score <= lo THEN 'novelty low' WHEN score <= hi THEN 'novelty medium' ELSE 'novelty high' END AS "level" FROM scores, k WHERE n >= 30) SELECT * FROM t WHERE (SELECT count(*) FROM (SELECT 1 FROM t GROUP BY "level" HAVING count(*) >= 10)) >= 2"""),
    "m8_forms": Query(lambda s, d: surrogate.forms(surrogate.players(events_choice(s, d)), outcome(s, d), folds=3, trees=5)),
    "n14_bootstrap": Query(lambda s, d: surrogate.bootstrapped(surrogate.players(events_choice(s, d)), outcome(s, d), 10.0, 2000)),
    "n3_co_choice": Query(lambda s, d: tables.co_choice(events_choice(s, d))),
    "n5_gate_draws": Query(gate_draws),
    "n6_recipes": Query(lambda s, d: checks.recipes_null(events_choice(s, d))),
    "n12_contraction": Query(contracted),
    "n13_auc": Query(lambda s, d: checks.auc_null(table(s, d, "embeddings").select("vec_id", F.element_at("embedding", 1).alias("x"), (F.col("label") % 2).alias("y")), "x", "y", "vec_id", 2000)),
}
