"""Queries on projections of the corpus, with the SQL that must agree. User turns are decisions, assistant turns claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.functions import stats
from manyways.model import CHOICE_SQL, EVENTS_SQL, Query, events_choice, on_events, orders_choice, table
from manyways.operators import agreement, forks, geometry, pairs, projections, sequence
from manyways.plans.documents_sql import SPAN_SQL, TURN_SQL, outcome, turns, two_spans
from manyways.plans.forks_sql import NOVEL, STATS
from manyways.plans.members_sql import NUMBERED_SQL, numbered
from manyways.plans.structure_sql import CELLS, ROUTES, TWO, builds

TALK_SQL = TURN_SQL.strip() + """, dd AS (SELECT run, id, substr(text, 1, 40) t FROM turn WHERE "role" = 'user'), cc AS (SELECT run, id, substr(text, 1, 40) t, ['did', 'did_not', 'found', 'would_have'][(id // 2) % 4 + 1] polarity FROM turn WHERE "role" = 'assistant'),
ll AS (SELECT run, decision_id, claim_id, CASE WHEN (run + decision_id) % 5 = 0 THEN 'misaligned' ELSE 'aligned' END agreement, 'note ' || claim_id::VARCHAR note FROM l WHERE (run + decision_id) % 7 <> 0),
gd AS (SELECT run, count(*) n, count(k) k FROM dd LEFT JOIN (SELECT DISTINCT run, decision_id id, 1 k FROM ll) USING (run, id) GROUP BY run),
gc AS (SELECT run, count(*) n, count(*) FILTER (polarity <> 'found' AND k IS NULL AND polarity = 'did') unbacked, count(*) FILTER (polarity <> 'found' AND k IS NULL AND polarity <> 'did') negatives, count(*) FILTER (polarity = 'found') deferred FROM cc LEFT JOIN (SELECT DISTINCT run, claim_id id, 1 k FROM ll) USING (run, id) GROUP BY run),
grid AS (SELECT run, COALESCE(gd.k, 0) linked, CASE WHEN COALESCE(gc.n, 0) > 0 THEN COALESCE(gd.n, 0) - COALESCE(gd.k, 0) ELSE 0 END silent, CASE WHEN COALESCE(gc.n, 0) > 0 THEN 0 ELSE COALESCE(gd.n, 0) END unassessable, COALESCE(unbacked, 0) unbacked, COALESCE(negatives, 0) negatives, COALESCE(deferred, 0) deferred FROM gd FULL JOIN gc USING (run))
"""
HOLD_SQL = """hx AS (SELECT DISTINCT c_nationkey::BIGINT x, l_partkey k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity < 12), hy AS (SELECT DISTINCT s_nationkey::BIGINT x, l_partkey k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity < 25),
{0}"""
DIST_SQL = ", ".join(f"n{h} AS (SELECT x, count(*) n FROM h{h} GROUP BY x), c{h} AS (SELECT p.x i, q.x j, count(*) n FROM h{h} p JOIN h{h} q ON p.k = q.k AND p.x < q.x GROUP BY ALL), d{h} AS (SELECT p.x i, q.x j, 1 - COALESCE(c.n, 0) / (p.n + q.n - COALESCE(c.n, 0)) d FROM n{h} p JOIN n{h} q ON p.x < q.x LEFT JOIN c{h} c ON c.i = p.x AND c.j = q.x)" for h in "xy")
GEO = "WITH " + HOLD_SQL.format(DIST_SQL)
CENTRED = ", " + ", ".join(f"f{h} AS (SELECT i, j, d FROM d{h} UNION ALL SELECT j, i, d FROM d{h} UNION ALL SELECT x, x, 0 FROM n{h}), z{h} AS (SELECT i, j, d - avg(d) OVER (PARTITION BY i) - avg(d) OVER (PARTITION BY j) + avg(d) OVER () c FROM f{h})" for h in "xy")


def talk(spark, sf_dir):
    """decisions (run, id, text), claims (run, id, text, polarity) and links with their agreement."""
    _, _, link = turns(spark, sf_dir)
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("id"), "role", F.substring("text", 1, 40).alias("text"))
    polarity = F.element_at(F.array(*map(F.lit, ("did", "did_not", "found", "would_have"))), (F.floor(F.col("id") / 2) % 4 + 1).cast("int"))
    links = link.filter((F.col("run") + F.col("decision_id")) % 7 != 0).withColumn("agreement", F.when((F.col("run") + F.col("decision_id")) % 5 == 0, "misaligned").otherwise("aligned")).withColumn("note", F.concat(F.lit("note "), F.col("claim_id").cast("string")))
    return t.filter("role = 'user'").drop("role"), t.filter("role = 'assistant'").drop("role").withColumn("polarity", polarity), links


def nations(spark, sf_dir):
    """Distances of customers' nations, and of suppliers', by the parts in their line items."""
    line = table(spark, sf_dir, "lineitem")
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    x = line.filter("l_quantity < 12").join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("x"), "l_partkey")
    y = line.filter("l_quantity < 25").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("long").alias("x"), "l_partkey")
    return geometry.distances(x, "l_partkey", "x"), geometry.distances(y, "l_partkey", "x")


def regions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("item"), F.col("n_regionkey").alias("label"))


def slots(spark, sf_dir):
    a = forks.modal(events_choice(spark, sf_dir)).select(F.col("fork").alias("slot"), "run", F.col("option").alias("choice"))
    return a, forks.modal(orders_choice(spark, sf_dir)).filter("fork not like '%/%'").select("fork", "run", F.col("option").alias("choice"))


SLOT_SQL = f"""WITH {CHOICE_SQL}{STATS}, ev AS (SELECT user_id run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) line, event_type AS fork, COALESCE(floor(value / 5)::BIGINT::VARCHAR, 'none') AS option FROM events),
em AS (SELECT fork slot, run, option a FROM (SELECT fork, run, option, count(*) n, min(line) seen FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fork, run ORDER BY n DESC, seen) = 1),
sh AS (SELECT slot, modal.fork, run, a, option b FROM em JOIN modal USING (run) WHERE modal.fork NOT LIKE '%/%'), fi AS (SELECT slot, fork FROM sh GROUP BY ALL HAVING count(*) >= 30 AND count(DISTINCT a) >= 2 AND count(DISTINCT b) >= 2), t AS (SELECT sh.* FROM sh JOIN fi USING (slot, fork))
"""
AMI_SQL = """, cell AS (SELECT {k} a, b, count(*)::DOUBLE n FROM t GROUP BY ALL), sa AS (SELECT {k} a, sum(n) na FROM cell GROUP BY ALL), sb AS (SELECT {k} b, sum(n) nb FROM cell GROUP BY ALL), tt AS (SELECT {k} 1 one, sum(n) t FROM cell GROUP BY ALL),
mi AS (SELECT {k} 1 one, sum(n / t * ln(n * t / (na * nb))) mi FROM cell JOIN sa USING ({u} a) JOIN sb USING ({u} b) JOIN tt {j} GROUP BY ALL), ha AS (SELECT {k} 1 one, -sum(na / t * ln(na / t)) ha FROM sa JOIN tt {j} GROUP BY ALL), hb AS (SELECT {k} 1 one, -sum(nb / t * ln(nb / t)) hb FROM sb JOIN tt {j} GROUP BY ALL),
pp AS (SELECT {k} na, nb, t, count(*) m FROM sa JOIN sb {j2} JOIN tt {j} GROUP BY ALL), ee AS (SELECT *, unnest(range(greatest(1, na + nb - t)::BIGINT, least(na, nb)::BIGINT + 1))::DOUBLE k FROM pp),
em2 AS (SELECT {k} 1 one, sum(m * k / t * ln(t * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) emi FROM ee GROUP BY ALL),
ami AS (SELECT {k} t::BIGINT n, mi, (mi - emi) / ((ha + hb) / 2 - emi) ami FROM mi JOIN em2 USING ({u} one) JOIN ha USING ({u} one) JOIN hb USING ({u} one) JOIN tt USING ({u} one))
"""


def tokens(spark, sf_dir):
    """Words of option labels: the brand and the types of the forks it is taken at."""
    c = orders_choice(spark, sf_dir)
    words = F.explode(F.array(F.col("option"), F.substring_index("fork", "/", 1), F.concat(F.lit("size"), F.substring_index("fork", "/", -1))))
    labels = c.select(F.concat_ws("|", "fork", "option").alias("option"), words.alias("token")).distinct()
    runs = c.agg(F.countDistinct("run").alias("n"))
    share = c.select(F.concat_ws("|", "fork", "option").alias("option"), "fork", "run").groupBy("option", "fork").agg(F.countDistinct("run").alias("k")).crossJoin(runs).select("option", "fork", (F.col("k") / F.col("n")).alias("share"))  # one row
    return labels, share


def kinded(spark, sf_dir):
    a, b = two_spans(spark, sf_dir)
    return a, b.withColumn("kind", F.when(F.col("id") % 2 == 0, "intron").otherwise("decision"))


def edge_maps(spark, sf_dir):
    c = events_choice(spark, sf_dir)
    short = F.upper(F.substring("fork", 1, 2))
    other = sequence.highways(c.filter("run % 2 = 0").withColumn("fork", short), 1)
    return sequence.highways(c, 1), c.filter("fork <> 'error'").select("fork", short.alias("to")).distinct(), other


EDGE_SQL = """, rt AS (SELECT run, fork a, COALESCE("to", start) b FROM steps WHERE fork <> COALESCE("to", start)), ed AS (SELECT least(a, b) x, greatest(a, b) y, count(DISTINCT run) n FROM rt GROUP BY ALL),
c2 AS (SELECT * REPLACE (upper(substr(fork, 1, 2)) AS fork) FROM choice WHERE run % 2 = 0), st2 AS (SELECT *, lead(fork) OVER w "to", first_value(fork) OVER w AS start FROM c2 WINDOW w AS (PARTITION BY run ORDER BY line, "rank", fork, did)),
ot AS (SELECT least(a, b) u, greatest(a, b) v, count(DISTINCT run) m FROM (SELECT run, fork a, COALESCE("to", start) b FROM st2 WHERE fork <> COALESCE("to", start)) GROUP BY ALL)
"""


def drifted(spark, sf_dir):
    c = orders_choice(spark, sf_dir)
    after = c.filter("run % 3 <> 0").withColumn("fork", F.when(F.col("fork") == "PROMO", F.concat("fork", (F.col("did") % 3).cast("string"))).otherwise(F.substring_index("fork", "/", 1)))
    both = c.select(F.col("fork").alias("a"), F.when(F.col("fork") == "PROMO", F.concat("fork", (F.col("did") % 3).cast("string"))).otherwise(F.substring_index("fork", "/", 1)).alias("b"))
    return agreement.drift(forks.fork_stats(c), forks.fork_stats(after), agreement.best_match(both, "containment"))


def screened(spark, sf_dir):
    j = pairs.jaccard(orders_choice(spark, sf_dir), "run", "fork", 0.03).select("a", "b", F.col("jaccard").alias("score"))
    truth = j.filter(F.substring_index("a", "/", 1) == F.substring_index("b", "/", 1))
    return agreement.recall_at(j, truth, [10, 100, 1000])


QUERIES = {
    "p9_claim_kinds": Query(lambda s, d: projections.claim_kinds(talk(s, d)[1]).groupBy("kind").agg(F.count("*").alias("n")), f"WITH {TALK_SQL} SELECT CASE WHEN polarity = 'found' THEN 'result' ELSE 'action' END kind, count(*) n FROM cc GROUP BY 1"),
    "j3_presence_grid": Query(lambda s, d: projections.presence_grid(*talk(s, d)), f"WITH {TALK_SQL} SELECT * FROM grid"),
    "j4_misalignments": Query(lambda s, d: projections.misalignments(*talk(s, d)), f"WITH {TALK_SQL} SELECT ll.run, dd.t decision, cc.t claim, note FROM ll JOIN dd ON dd.run = ll.run AND dd.id = decision_id JOIN cc ON cc.run = ll.run AND cc.id = claim_id WHERE agreement = 'misaligned'"),
    "j5_silent_forks": Query(lambda s, d: projections.silent_forks(numbered(s, d).filter("did % 5 = 0").select("run", F.concat(F.lit(" "), F.col("option")).alias("text")), numbered(s, d).filter("did % 3 <> 0").withColumn("text", F.concat("option", F.lit("  ")))), f"WITH {CHOICE_SQL}, {NUMBERED_SQL}, z AS (SELECT run, option AS text, arg_max(fork, did) fork FROM num WHERE did % 3 <> 0 GROUP BY ALL) SELECT n.run, n.option AS text, z.fork FROM num n LEFT JOIN z ON z.run = n.run AND z.text = n.option WHERE did % 5 = 0"),
    "a20_rollup": Query(lambda s, d: (lambda x, y, z: projections.rollup(projections.presence_grid(x, y, z), z, x.select("run", (F.col("run") % 4).alias("arm")).distinct()))(*talk(s, d)), f"""WITH {TALK_SQL}, m AS (SELECT run, count(*) FILTER (agreement = 'misaligned') x FROM ll GROUP BY run), t AS (SELECT grid.*, run % 4 arm, COALESCE(x, 0) x FROM grid JOIN (SELECT DISTINCT run FROM dd) USING (run) LEFT JOIN m USING (run))
        SELECT arm, count(*) runs, sum(silent)::BIGINT silent, round(sum(silent) / sum(linked + silent), 6) silent_share, round(sum(x) / count(*), 6) misaligned_per_run FROM t GROUP BY GROUPING SETS ((arm), ())"""),
    "x31_items": Query(lambda s, d: (lambda x, y, z: projections.items(x, x.filter("id % 4 = 0"), projections.misalignments(x, y, z)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))(*talk(s, d)), f"""WITH {TALK_SQL}, i AS (SELECT 'decision' AS source, t FROM dd UNION ALL SELECT 'silent', t FROM dd WHERE id % 4 = 0 UNION ALL SELECT 'misaligned', note FROM ll JOIN dd ON dd.run = ll.run AND dd.id = decision_id JOIN cc ON cc.run = ll.run AND cc.id = claim_id WHERE agreement = 'misaligned')
        SELECT source, count(*) n, sum(length(t))::BIGINT chars FROM i GROUP BY source"""),
    "a16_deviations": Query(lambda s, d: projections.deviations(outcome(s, d).withColumn("f", F.col("run") % 3 == 0), "y", "f"), "WITH t AS (SELECT o_custkey run, avg(o_totalprice) v FROM orders GROUP BY 1), m AS (SELECT list_sort(list(v))[(floor(count(*) / 2) + 1)::INT] m FROM t), u AS (SELECT run, abs(v - m) d, m FROM t, m), k AS (SELECT list_sort(list(d))[(floor(count(*) / 2) + 1)::INT] mad FROM u) SELECT round(any_value(m), 6) AS median, round(any_value(mad), 6) AS mad, round(avg(d / mad), 6) AS every, round(avg(d / mad) FILTER (run % 3 = 0), 6) flagged FROM u, k"),
    "a18_bands": Query(lambda s, d: (lambda c: projections.bands(c, forks.option_runs(c).filter("c <= 30")))(orders_choice(s, d)), f"WITH {CHOICE_SQL}{STATS}, t AS (SELECT fork, option, least(floor(line / max(line) OVER (PARTITION BY run) * 5), 4)::BIGINT band FROM choice) SELECT band, count(*) decisions, count(c) novel, round(count(c) / count(*), 6) rate FROM t LEFT JOIN (SELECT * FROM option_runs WHERE c <= 30) USING (fork, option) GROUP BY band"),
    "a18_novelty_outcome": Query(lambda s, d: stats.spearman(forks.run_novelty(orders_choice(s, d)).join(outcome(s, d), "run"), "score", "y"), f"WITH {CHOICE_SQL}{STATS}{NOVEL}, y AS (SELECT o_custkey run, avg(o_totalprice) y FROM orders GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 b FROM scores JOIN y USING (run)) SELECT count(*) n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) ELSE 0 END, 6) rho FROM r"),
    "x34_run_rows": Query(lambda s, d: projections.run_rows(events_choice(s, d), events_choice(s, d).filter("did % 9 = 0").select("did"), outcome(s, d).select("run", F.round("y", 6).alias("y"))), f"""WITH {EVENTS_SQL}, f AS (SELECT run, fork, min(line) m FROM choice GROUP BY ALL), v AS (SELECT run, string_agg(fork, '>' ORDER BY m, fork) forks FROM f GROUP BY run), q AS (SELECT run, string_agg(line::VARCHAR, ',' ORDER BY line) silent_lines FROM (SELECT DISTINCT run, line FROM choice WHERE did % 9 = 0) GROUP BY run), o AS (SELECT o_custkey run, round(avg(o_totalprice), 6) y FROM orders GROUP BY 1)
        SELECT run, decisions, forks, COALESCE(silent_lines, '') silent_lines, y FROM (SELECT run, count(*) decisions FROM choice GROUP BY run) JOIN v USING (run) LEFT JOIN q USING (run) LEFT JOIN o USING (run)"""),
    "x35_expected_walks": on_events(lambda c: projections.expected_walks(sequence.routes(c)), ROUTES + ", d AS (SELECT DISTINCT run, arm, a, b FROM routes), k AS (SELECT arm, count(DISTINCT run) k FROM routes GROUP BY arm), n AS (SELECT a, b, count(DISTINCT run) n FROM d GROUP BY ALL) SELECT a, b, arm, count(*) walked, round(any_value(n) * any_value(k) / (SELECT sum(k) FROM k), 6) expected FROM d JOIN n USING (a, b) JOIN k USING (arm) GROUP BY ALL"),
    "x39_run_routes": on_events(lambda c: sequence.routes(c).select("run", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ROUTES + "SELECT DISTINCT run, least(a, b) a, greatest(a, b) b FROM routes"),
    "a41_ami": Query(lambda s, d: agreement.adjusted_mutual_information(builds(s, d).select("a", "b")), "WITH " + TWO[2:].strip() + ", t AS (SELECT a, b FROM items)" + AMI_SQL.format(k="", u="", j="ON true", j2="ON true") + "SELECT n, round(mi, 6) mi, round(ami, 6) ami FROM ami"),
    "p11_comparable": Query(lambda s, d: agreement.comparable(*slots(s, d)).groupBy("slot", "fork").agg(F.count("*").alias("runs")), SLOT_SQL + "SELECT slot, fork, count(*) runs FROM t GROUP BY ALL"),
    "x21_slot_ami": Query(lambda s, d: agreement.adjusted_mutual_information(agreement.comparable(*slots(s, d)), "slot", "fork"), SLOT_SQL + AMI_SQL.format(k="slot, fork,", u="slot, fork,", j="USING (slot, fork)", j2="USING (slot, fork)") + "SELECT slot, fork, n, round(mi, 6) mi, round(ami, 6) ami FROM ami"),
    "j18_best_slots": Query(lambda s, d: agreement.best_slots(*slots(s, d)), SLOT_SQL + AMI_SQL.format(k="slot, fork,", u="slot, fork,", j="USING (slot, fork)", j2="USING (slot, fork)") + "SELECT slot, fork, round(ami, 6) ami FROM ami QUALIFY row_number() OVER (PARTITION BY slot ORDER BY round(ami, 6) DESC, fork) = 1"),
    "j12_best_match": Query(lambda s, d: agreement.best_match(builds(s, d).select("a", "b")), "WITH " + TWO[2:].strip() + CELLS.format(k="", b="b", n="count(*)") + "SELECT a, b, n::BIGINT n, round(n / (na + nb - n), 6) jaccard, round(n / least(na, nb), 6) containment FROM cell JOIN sa USING (a) JOIN sb USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, n / (na + nb - n) DESC, b) = 1"),
    "j12_by_containment": Query(lambda s, d: agreement.best_match(builds(s, d).select("a", F.col("c").alias("b")), "containment"), "WITH " + TWO[2:].strip() + CELLS.format(k="", b="c", n="count(*)") + "SELECT a, b, n::BIGINT n, round(n / (na + nb - n), 6) jaccard, round(n / least(na, nb), 6) containment FROM cell JOIN sa USING (a) JOIN sb USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n / least(na, nb) DESC, n DESC, b) = 1"),
    "j13_remapped": Query(lambda s, d: agreement.remapped(*edge_maps(s, d)), f"""WITH {EVENTS_SQL}, steps AS (SELECT *, lead(fork) OVER w "to", first_value(fork) OVER w AS start FROM choice WINDOW w AS (PARTITION BY run ORDER BY line, "rank", fork, did)){EDGE_SQL}, mp AS (SELECT x, y, least(upper(substr(x, 1, 2)), upper(substr(y, 1, 2))) u, greatest(upper(substr(x, 1, 2)), upper(substr(y, 1, 2))) v, n FROM ed WHERE x <> 'error' AND y <> 'error')
        SELECT x, y, u, v, n, COALESCE(m, 0) m FROM mp LEFT JOIN ot USING (u, v)"""),
    "a43_drift": Query(drifted, f"""WITH {CHOICE_SQL}, b2 AS (SELECT *, CASE WHEN fork = 'PROMO' THEN fork || (did % 3)::VARCHAR ELSE split_part(fork, '/', 1) END g FROM choice), two AS (SELECT 'x' w, fork, run, option, line FROM b2 UNION ALL SELECT 'y', g, run, option, line FROM b2 WHERE run % 3 <> 0),
        md AS (SELECT w, fork, run, option FROM (SELECT w, fork, run, option, count(*) n, min(line) seen FROM two GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY w, fork, run ORDER BY n DESC, seen) = 1), vt AS (SELECT w, fork, option, count(*) c FROM md GROUP BY ALL), tot AS (SELECT w, count(DISTINCT run) n FROM two GROUP BY w),
        st AS (SELECT w, fork, round(sum(c) / any_value(n), 6) cov, round(sum(c) * sum(c) / sum(c * c), 6) eff FROM vt JOIN tot USING (w) GROUP BY ALL), ce AS (SELECT fork a, g b, count(*) n FROM b2 GROUP BY ALL), na AS (SELECT a, sum(n) na FROM ce GROUP BY a), nb AS (SELECT b, sum(n) nb FROM ce GROUP BY b),
        bm AS (SELECT a, b, round(n / least(na, nb), 6) k FROM ce JOIN na USING (a) JOIN nb USING (b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY n / least(na, nb) DESC, n DESC, b) = 1), many AS (SELECT b, count(*) m FROM bm GROUP BY b)
        SELECT x.fork, b, round(y.cov - x.cov, 6) coverage_delta, round(y.eff - x.eff, 6) eff_delta, CASE WHEN k < 0.5 THEN 'scattered' WHEN m > 1 THEN 'merged' ELSE 'matched' END AS event FROM bm JOIN many USING (b) JOIN st x ON x.w = 'x' AND x.fork = a LEFT JOIN st y ON y.w = 'y' AND y.fork = b"""),
    "a44_recall": Query(screened, f"""WITH {CHOICE_SQL}, d AS (SELECT DISTINCT run, fork FROM choice), s AS (SELECT fork, count(*) z FROM d GROUP BY fork), p AS (SELECT x.fork a, y.fork b, count(*) n FROM d x JOIN d y ON x.run = y.run AND x.fork < y.fork GROUP BY ALL),
        j AS (SELECT a, b, round(n / (s.z + t.z - n), 6) score FROM p JOIN s ON s.fork = a JOIN s t ON t.fork = b WHERE round(n / (s.z + t.z - n), 6) >= 0.03), r AS (SELECT *, split_part(a, '/', 1) = split_part(b, '/', 1) good, row_number() OVER (ORDER BY score DESC, a, b) rn FROM j)
        SELECT k::INT budget, count(*) FILTER (good AND rn <= k) AS found, round(count(*) FILTER (good AND rn <= k) / count(*) FILTER (good), 6) recall FROM r, (SELECT unnest([10, 100, 1000]) k) GROUP BY k"""),
    "a40_variance": Query(lambda s, d: agreement.variance_split(table(s, d, "part").select((F.col("p_size") % 4).alias("parent_a"), (F.col("p_partkey") % 4).alias("parent_b"), (F.col("p_partkey") * 37 % 100 / 100).alias("value"))), "WITH t AS (SELECT p_size % 4 = p_partkey % 4 s, (p_partkey * 37 % 100) / 100 v FROM part) SELECT round(avg(v) FILTER (s), 6) \"within\", round(stddev_samp(v) FILTER (s), 6) within_sd, round(avg(v) FILTER (NOT s), 6) AS between, round(stddev_samp(v) FILTER (NOT s), 6) between_sd, round((1 - avg(v) FILTER (s)) / (1 - avg(v) FILTER (NOT s)), 6) induction_share FROM t".replace("AS between,", 'AS "between",')),
    "a38_line_agreement": Query(lambda s, d: agreement.line_agreement(*kinded(s, d)), f"""WITH {SPAN_SQL}, x AS (SELECT run, id a, kind, unnest(range("start", "end" + 1)) line FROM a), y AS (SELECT run, id b, CASE WHEN id % 2 = 0 THEN 'intron' ELSE 'decision' END kind, unnest(range("start", "end" + 1)) line FROM b), t AS (SELECT run, line, a, b, x.kind = y.kind same FROM x JOIN y USING (run, line)),
        c AS (SELECT run, a, b, count(*)::DOUBLE n FROM t GROUP BY ALL), sa AS (SELECT run, sum(n * (n - 1) / 2) x FROM (SELECT run, a, sum(n) n FROM c GROUP BY ALL) GROUP BY run), sb AS (SELECT run, sum(n * (n - 1) / 2) y FROM (SELECT run, b, sum(n) n FROM c GROUP BY ALL) GROUP BY run), ss AS (SELECT run, sum(n * (n - 1) / 2) s, sum(n) t FROM c GROUP BY run), ks AS (SELECT run, round(avg(same::INT), 6) kinds FROM t GROUP BY run)
        SELECT run, t::BIGINT items, round(CASE WHEN (x + y) / 2 = x * y / (t * (t - 1) / 2) THEN 1 ELSE (s - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)) END, 6) ari, kinds, 0::BIGINT spans_delta FROM ss JOIN sa USING (run) JOIN sb USING (run) JOIN ks USING (run)"""),
    "a36_matched_levels": Query(lambda s, d: agreement.matched_levels(builds(s, d).select("a", F.col("c").alias("b")))),  # the order decides; tests/test_matching.py has brute force
    "g23_distances": Query(lambda s, d: nations(s, d)[0].withColumn("d", F.round("d", 6)), GEO + " SELECT i, j, round(d, 6) d FROM dx"),
    "g24_mantel": Query(lambda s, d: geometry.mantel(*nations(s, d)), GEO + " SELECT count(*) pairs, round(corr(dx.d, dy.d), 6) r FROM dx JOIN dy USING (i, j)"),
    "g25_distance_correlation": Query(lambda s, d: geometry.distance_correlation(*nations(s, d)), GEO + CENTRED + " SELECT round(sqrt(greatest(avg(zx.c * zy.c), 0) / sqrt(avg(zx.c * zx.c) * avg(zy.c * zy.c))), 6) dcor FROM zx JOIN zy USING (i, j)"),
    "g26_within_between": Query(lambda s, d: geometry.within_between(nations(s, d)[0], regions(s, d)), GEO + """, t AS (SELECT 1 - d s, p.n_regionkey = q.n_regionkey e FROM dx JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j) SELECT round(avg(s) FILTER (e), 6) "within", round(avg(s) FILTER (NOT e), 6) "between", round(avg(s) FILTER (e) - avg(s) FILTER (NOT e), 6) delta FROM t"""),
    "n9_mantel_null": Query(lambda s, d: geometry.relabel_null(*nations(s, d))),
    "n9_dcor_null": Query(lambda s, d: geometry.relabel_null(*nations(s, d), 200, "dcor")),
    "n10_label_null": Query(lambda s, d: geometry.label_null(nations(s, d)[0], regions(s, d))),
    "n11_traffic_null": Query(lambda s, d: geometry.traffic_null(agreement.remapped(*edge_maps(s, d)).select(F.concat_ws("-", "x", "y").alias("item"), F.col("n").alias("x"), F.col("m").alias("y")))),
    "g20_core_first": Query(lambda s, d: geometry.core_first(*tokens(s, d), core=0.05, rank=16)),
    "g21_lsa": Query(lambda s, d: geometry.lsa_similarity(tokens(s, d)[0].filter("option like 'PROMO%'").withColumnRenamed("option", "item"), 16)),
    "n15_random_cores": Query(lambda s, d: geometry.random_cores(tokens(s, d)[1])),
}
