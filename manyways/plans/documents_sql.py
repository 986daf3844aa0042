"""Queries on texts, spans, clusters, audits, surrogates and nulls; SQL where DuckDB can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from manyways.functions import text
from manyways.model import CHOICE_SQL, EVENTS_SQL, Query, events_choice, on_orders, orders_choice, table
from manyways.operators import audit, cluster, forks, resample, sequence, spans, surrogate, tables, trades
from manyways.plans.forks_sql import STATS
from manyways.operators.cluster import cut, shared
from manyways.sources import corpus
from manyways.streaming import incremental, islands

JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"
GRAMS = "(CASE WHEN length({0}) >= 3 THEN list_distinct([substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)]) ELSE [] END)"
WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9.]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.WORD_STOP) + ")))"
SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, COALESCE(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 8 HOUR, false)::INT n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) k FROM g)
        SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 8 HOUR AS "end", count(*) "events" FROM s GROUP BY user_id, k"""
ALIKE_SQL = f"""w AS (SELECT item_id, text, {WORDS.format('text')} ws FROM benchmark), t AS (SELECT item_id, unnest(ws) x FROM w), r AS (SELECT x FROM t GROUP BY x HAVING count(*) BETWEEN 2 AND 5),
c AS (SELECT DISTINCT a.item_id a, b.item_id b FROM t a JOIN t b ON a.x = b.x AND a.item_id < b.item_id JOIN r ON r.x = a.x), p AS (SELECT a, b, m.ws x, n.ws y, trim(regexp_replace(lower(m.text), '\\s+', ' ', 'g')) u, trim(regexp_replace(lower(n.text), '\\s+', ' ', 'g')) v FROM c JOIN w m ON m.item_id = a JOIN w n ON n.item_id = b)
"""
SENTENCES_SQL = """q AS (SELECT p_partkey id, ['drop the ', 'do not use the ', 'never fit the ', 'exclude no ', 'no weights for ', 'without using the '][p_partkey % 6 + 1] || p_name || [' and then log it, with care', ' or a ' || p_type, ' (one / two)', ''][p_partkey % 4 + 1] t FROM part)"""
TURN_SQL = """turn AS (SELECT conv_id run, turn id, "role", text, lead("role") OVER (PARTITION BY conv_id ORDER BY turn, text) nxt, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, text) nt FROM conversations),
d AS (SELECT run, id FROM turn WHERE "role" = 'user'), c AS (SELECT run, id FROM turn WHERE "role" = 'assistant'), l AS (SELECT DISTINCT run, id decision_id, nt claim_id FROM turn WHERE "role" = 'user' AND nxt = 'assistant')
"""
SPAN_SQL = """s AS (SELECT doc_id run, (n_chars % 7)::BIGINT AS shift FROM documents), a AS (SELECT run, k id, 1 + 10 * k AS "start", 8 + 10 * k AS "end", CASE WHEN k % 3 = 0 THEN 'intron' ELSE 'decision' END kind FROM s, (SELECT unnest(range(0, 6)) k)),
b AS (SELECT run, k id, 1 + 10 * k + shift AS "start", 8 + 10 * k + shift AS "end" FROM s, (SELECT unnest(range(0, 6)) k))
"""
OVERLAP_SQL = """, x AS (SELECT run, id, unnest(range("start", "end" + 1)) line FROM a), y AS (SELECT run, id, unnest(range("start", "end" + 1)) line FROM b),
o AS (SELECT x.run, x.id i, y.id j, count(*) n FROM x JOIN y USING (run, line) GROUP BY ALL), p AS (SELECT *, round(n / (16 - n), 6) jaccard FROM o)
"""


def turns(spark, sf_dir):
    """User turns as decisions, assistant turns as claims; a user turn and an assistant turn next to it are linked."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("id"), "role", F.lead("role").over(w).alias("nxt"), F.lead("turn").over(w).alias("nt"))
    link = t.filter("role = 'user' and nxt = 'assistant'").select("run", F.col("id").alias("decision_id"), F.col("nt").alias("claim_id")).distinct()
    return t.filter("role = 'user'").select("run", "id"), t.filter("role = 'assistant'").select("run", "id"), link


def two_spans(spark, sf_dir):
    """Six spans of eight lines for each document, and the same shifted by up to six lines."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run"), (F.col("n_chars") % 7).alias("shift")).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    kind = F.when(F.col("id") % 3 == 0, "intron").otherwise("decision")
    a = d.select("run", "id", (1 + 10 * F.col("id")).alias("start"), (8 + 10 * F.col("id")).alias("end"), kind.alias("kind"))
    b = d.select("run", "id", (1 + 10 * F.col("id") + F.col("shift")).alias("start"), (8 + 10 * F.col("id") + F.col("shift")).alias("end"))
    return a, b


def like_parts(spark, sf_dir):
    """Part kinds that share all words but one: edges for components."""
    return forks.reach(orders_choice(spark, sf_dir)).select("fork", F.split("fork", "[ /]").alias("t")).select("fork", F.explode("t").alias("token"))


def type_edges(spark, sf_dir):
    """Forks of one part type follow each other by name."""
    from pyspark.sql import Window

    f = orders_choice(spark, sf_dir).select("fork").distinct().withColumn("type", F.substring_index("fork", "/", 1))
    w = Window.partitionBy("type").orderBy("fork")
    return f.select("type", F.col("fork").alias("a"), F.lead("fork").over(w).alias("b")).filter("b is not null")


def outcome(spark, sf_dir):
    """The mean price of a customer's orders, added up in order: the same prices have the same mean, and so share their rank."""
    prices = F.array_sort(F.collect_list("o_totalprice"))  # a customer's orders
    mean = F.aggregate(prices, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(prices), F.lit(0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(mean.alias("y"))


def every_player(spark, sf_dir):
    """Segment players: the options at all forks that players() admits."""
    return surrogate.players(orders_choice(spark, sf_dir))


def surrogate_strengths(spark, sf_dir):
    levels, y = cut(every_player(spark, sf_dir)), outcome(spark, sf_dir)
    m = surrogate.summed(levels, y)
    return surrogate.strengths(surrogate.attributions(levels, m.columns, surrogate.solved(m, [(-1, 10.0)])[-1, 10.0][0]))


def cross_validation(spark, sf_dir):
    best, scores = surrogate.cross_validated(cut(every_player(spark, sf_dir)), outcome(spark, sf_dir))
    return spark.createDataFrame([(float(k), float(v), k == best) for k, v in scores.items()], "penalty double, r2 double, best boolean")


def surrogate_null(spark, sf_dir):
    return surrogate.payout_null(surrogate.present(orders_choice(spark, sf_dir)), outcome(spark, sf_dir), 10.0, 400)


def surrogate_audit(spark, sf_dir):
    y = outcome(spark, sf_dir)
    other = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_totalprice").alias("y"))
    return surrogate.audited(surrogate.present(orders_choice(spark, sf_dir)), {"mean": y, "largest": other}, orders_choice(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n")))


def walked(spark, sf_dir):
    return sequence.routes(events_choice(spark, sf_dir)).select("run", "arm", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def arm_edges(spark, sf_dir):
    e = walked(spark, sf_dir)
    items = e.select(F.concat_ws("|", "a", "b", "arm").alias("id")).distinct()

    def test(some, n):
        keep = some.select(F.split("id", r"\|").alias("k")).select(F.col("k")[0].alias("a"), F.col("k")[1].alias("b"), F.col("k")[2].alias("arm"))
        return resample.arm_edge_null(e, n).join(keep, ["a", "b", "arm"], "left_semi").withColumn("id", F.concat_ws("|", "a", "b", "arm"))

    return resample.escalated(test, items, 400, 4000, 0.02).drop("id")


def curveballs(spark, sf_dir):
    """Which forks runs reach together, against 400 draws: each is as large as the table."""
    return trades.co_occurrence_null(orders_choice(spark, sf_dir), "run", "fork", 400)


def streamed_sessions(spark, sf_dir):
    """The stream of events, run to its end, against a table of files: a last event far ahead moves the watermark past all sessions."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    at = f"{shared(spark)}/sessions-{uuid.uuid4().hex}"
    spark.createDataFrame([(-1, None, -1)], events.schema).select("event_id", F.to_timestamp(F.lit("2262-01-01")).alias("ts"), "user_id").write.parquet(f"{at}/end")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    end = spark.readStream.schema(events.schema).parquet(f"{at}/end")
    q = incremental.sessions(stream.union(end)).writeStream.format("parquet").option("path", f"{at}/sessions").outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/sessions").filter("user_id >= 0")


def streamed_stats(spark, sf_dir):
    """Decisions that arrive as a stream, kept as a table with statistics of the forks of the whole."""
    at = f"{shared(spark)}/stats-{uuid.uuid4().hex}"
    schema = events_choice(spark, sf_dir).select("did", "run", "line", "fork", "option").schema
    events_choice(spark, sf_dir).select("did", "run", "line", "fork", "option").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    incremental.keep_fork_stats(stream, f"{at}/history", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out")


VISIT_GAP = 6 * 3600
ISLANDS_SQL = f"""WITH {EVENTS_SQL}, t AS (SELECT run, fork, option, epoch_us(ts) AS "at" FROM choice WHERE run IS NOT NULL AND fork IS NOT NULL AND ts IS NOT NULL),
  n AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY run, fork, option ORDER BY "at") > {VISIT_GAP * 1_000_000} THEN 1 ELSE 0 END AS fresh FROM t),
  o AS (SELECT *, sum(fresh) OVER (PARTITION BY run, fork, option ORDER BY "at" ROWS UNBOUNDED PRECEDING)::BIGINT AS occurrence FROM n),
  i AS (SELECT run, fork, option, occurrence, min("at") AS a, max("at") AS b, count(*) AS decisions FROM o GROUP BY ALL)
  SELECT run, fork, option, occurrence, make_timestamp(a) AS start, make_timestamp(b) AS stop, decisions,
    count(*) OVER w AS visits, (sum(CASE WHEN occurrence = 0 THEN 1 ELSE 0 END) OVER w)::BIGINT AS options
  FROM i WINDOW w AS (PARTITION BY run ORDER BY b, fork, option ROWS UNBOUNDED PRECEDING)"""


def streamed_islands(spark, sf_dir):
    """The events, replayed in four bands of time as so many micro-batches; a last row far ahead moves the watermark past all islands."""
    c = events_choice(spark, sf_dir).select("run", "fork", "option", F.col("ts").cast("timestamp").alias("ts"))
    at = f"{shared(spark)}/islands-{uuid.uuid4().hex}"
    quarters = c.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0] or []
    bands = sum((F.unix_micros("ts") > q).cast("int") for q in quarters) if quarters else F.lit(0)
    for k in range(len(quarters) + 1):
        c.filter(bands == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
    c.limit(0).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("end"), F.lit("end"), F.to_timestamp(F.lit("2262-01-01")))).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    islands.keep_islands(stream, f"{at}/out", f"{at}/checkpoint", VISIT_GAP).awaitTermination()
    return spark.read.parquet(f"{at}/out").filter("run >= 0")


def streamed_windows(spark, sf_dir):
    """Decisions per fork and day of the events."""
    c = events_choice(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_forks(c)


def checksums(spark, sf_dir):
    """A manifest in which one file has changed, one is gone and one isn't listed."""
    found = corpus.checksums(spark, sf_dir, "{nation,region,orders}.parquet").select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")
    manifest = found.filter("path <> 'orders.parquet'").withColumn("sha256", F.when(F.col("path") == "nation.parquet", "0").otherwise(F.col("sha256")))
    return corpus.verify(manifest.union(spark.createDataFrame([("gone.parquet", "1")], "path string, sha256 string")), found)


def integrity(spark, sf_dir):
    """Members of which some are no decisions, and a node table that lacks a fork and has one too many."""
    c = orders_choice(spark, sf_dir)
    members = c.filter("did % 7 <> 0").select("did").union(c.filter("did % 97 = 0").select(F.col("did") + 10**12))
    f = c.select("fork").distinct()
    nodes = f.filter("fork <> 'PROMO'").union(spark.createDataFrame([("NO SUCH",)], "fork string"))
    return audit.integrity(members, c.select("did"), nodes, f)


def measured(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = p.agg((F.avg("p_size") / 50).alias("option_ari"), (F.countDistinct("p_brand") / 25).alias("fork_ari"), F.avg((F.col("p_size") > 5).cast("double")).alias("b_cubed"), F.avg((F.col("p_size") > 25).cast("double")).alias("rho"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in one.columns])).alias("x")).select("x.*")


def cutoffs(spark, sf_dir):
    """Parts as members of their brands, with sets of cut-offs some of which lie in others."""
    p = table(spark, sf_dir, "part")
    v, kind = (F.col("p_size") % 3).cast("double"), F.col("p_size") % 5
    values = F.when(kind == 0, F.array().cast("array<double>")).when(kind == 1, F.array(v)).when(kind == 2, F.array(v, F.lit(5.0))).when(kind == 3, F.array(F.lit(5.0))).otherwise(F.array(v, F.lit(5.0), F.lit(9.0)))
    return p.select(F.col("p_brand").alias("oid"), F.col("p_partkey").alias("did"), values.alias("values"))


QUERIES = {
    "s2_lines": Query(lambda s, d: spans.lines(table(s, d, "documents")), "SELECT doc_id, i AS line, parts[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) i FROM documents)"),
    "f_tokens": Query(lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(text.tokens(F.col("text"))).alias("token")), "SELECT item_id, t AS token FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) t FROM benchmark) WHERE length(t) > 2 AND t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP) + ")"),
    "f_word_jaccard": Query(lambda s, d: _alike(s, d).select("a", "b", F.round(text.jaccard(text.words(F.col("x")), text.words(F.col("y"))), 6).alias("jaccard"), F.round(text.containment(text.words(F.col("x")), text.words(F.col("y"))), 6).alias("containment")), f"WITH {ALIKE_SQL} SELECT a, b, round({JACCARD.format('x', 'y')}, 6) jaccard, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0 END, 6) containment FROM p"),
    "f_similarity": Query(lambda s, d: _alike(s, d).select("a", "b", F.round(text.similarity(F.col("x"), F.col("y")), 6).alias("similarity")), f"WITH {ALIKE_SQL}, g AS (SELECT *, {GRAMS.format('u')} gu, {GRAMS.format('v')} gv FROM p) SELECT a, b, round(greatest({JACCARD.format('x', 'y')}, {JACCARD.format('gu', 'gv')}), 6) similarity FROM g"),
    "f_norm_target": Query(lambda s, d: table(s, d, "part").select("p_partkey", text.norm_target(F.concat(F.lit("df_"), F.col("p_name"), F.lit("_log"))).alias("target")), """WITH n AS (SELECT p_partkey, regexp_replace(lower('df_' || p_name || '_log'), '[^a-z0-9]', '', 'g') t0 FROM part),
        a AS (SELECT p_partkey, CASE WHEN starts_with(t0, 'df') AND length(t0) > 4 THEN substr(t0, 3) ELSE t0 END t FROM n), b AS (SELECT p_partkey, CASE WHEN starts_with(t, 'data') AND length(t) > 6 THEN substr(t, 5) ELSE t END t FROM a), c AS (SELECT p_partkey, CASE WHEN starts_with(t, 'the') AND length(t) > 5 THEN substr(t, 4) ELSE t END t FROM b)
        """ + "".join(f", s{i} AS (SELECT p_partkey, CASE WHEN ends_with(t, '{x}') AND length(t) > {len(x) + 2} THEN left(t, length(t) - {len(x)}) ELSE t END t FROM {'c' if i == 0 else f's{i - 1}'})" for i, x in enumerate(text.SUFFIXES)) + " SELECT p_partkey, CASE WHEN t = '' THEN 'unknown' ELSE t END AS target FROM s8"),
    "f_handles": on_orders(lambda c: c.select("fork", "option").distinct().select(text.fork_handle(F.col("fork")).alias("fork"), text.option_handle(F.col("fork"), F.col("option")).alias("option")), " SELECT DISTINCT 'fork:' || substr(sha1(fork), 1, 8) AS fork, 'option:' || substr(sha1(fork || '|' || option), 1, 8) AS option FROM choice"),
    "f_predicates": Query(lambda s, d: sentences(s, d).select("id", text.negated(F.col("t")).alias("negated"), text.clauses(F.col("t")).cast("long").alias("clauses"), text.disjunctive(F.col("t")).alias("disjunctive")),
        f"WITH {SENTENCES_SQL} SELECT id, id % 6 IN (1, 2, 5) negated, 1 + len(regexp_extract_all(t, '\\b(?:and|then|while|after|before)\\b|[,;]|\\bwith\\b')) clauses, regexp_matches(t, '\\s/\\s|\\bor\\b|\\([^)]*/[^)]*\\)') disjunctive FROM q"),
    "f_concedes": Query(lambda s, d: sentences(s, d).select("id", text.concedes(F.col("note")).alias("concedes")), f"WITH {SENTENCES_SQL} SELECT id, id % 4 IN (0, 3) concedes FROM q"),
    "f_thresholds": Query(lambda s, d: sentences(s, d).select("id", F.array_join(text.thresholds(F.col("cut")).cast("array<string>"), ",").alias("slots")), f"""WITH {SENTENCES_SQL}, v AS (SELECT id, list_sort(list_distinct([(id % 7 + CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END)::DOUBLE, id % 5 + 0.5])) s FROM q)
        SELECT id, array_to_string([x::VARCHAR FOR x IN s], ',') slots FROM v"""),
    "f_tag_norm": Query(lambda s, d: table(s, d, "part").select("p_partkey", text.tag_norm(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" - "), F.col("p_brand"))).alias("tag")), "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9 ]', '', 'g')) tag FROM part"),
    "f_idf": Query(lambda s, d: word_weights(s, d), "WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) w FROM part), n AS (SELECT count(DISTINCT p_partkey) n FROM t) SELECT w, count(*) df, round(ln(any_value(n) / count(*)), 6) idf, round(ln(1 + any_value(n) / count(*)), 6) smooth, round(1 / count(*), 6) inverse FROM t, n GROUP BY w"),
    "f_required_keys": Query(lambda s, d: table(s, d, "events").select("event_id", text.has_keys(F.col("props"), ["k"]).alias("fine"), text.has_keys(F.col("props"), ["k", "missing"]).alias("both")), "SELECT event_id, json_extract(props, '$.k') IS NOT NULL fine, false AS \"both\" FROM events"),
    "f_clipped": Query(lambda s, d: table(s, d, "part").select("p_partkey", text.clipped(F.concat_ws(" ", "p_name", "p_type"), 12).alias("t")), "SELECT p_partkey, CASE WHEN length(x) <= 12 THEN x ELSE regexp_replace(substr(x, 1, 12), '\\s+\\S*$', '') || '…' END t FROM (SELECT p_partkey, p_name || ' ' || p_type x FROM part)"),
    "f_answers": Query(lambda s, d: table(s, d, "part").select("p_partkey", F.explode(text.answers(F.concat(F.lit("# sheet\n1. answer: same\n**2.** answer: "), F.lower("p_type"), F.lit("\nno 3. answer: x"))))).select("p_partkey", F.col("key").alias("number"), F.col("value").alias("answer")), "SELECT p_partkey, '1' AS number, 'same' AS answer FROM part UNION ALL SELECT p_partkey, '2', lower(p_type) FROM part"),
    "j3_presence": Query(lambda s, d: (lambda a, b, l: spans.presence(a, b, l))(*turns(s, d)), f"""WITH {TURN_SQL}, x AS (SELECT d.run, count(*) n, count(l.decision_id) k FROM d LEFT JOIN (SELECT DISTINCT run, decision_id FROM l) l ON d.run = l.run AND d.id = l.decision_id GROUP BY d.run), y AS (SELECT c.run, count(*) n, count(l.claim_id) k FROM c LEFT JOIN (SELECT DISTINCT run, claim_id FROM l) l ON c.run = l.run AND c.id = l.claim_id GROUP BY c.run)
        SELECT run, COALESCE(x.k, 0) linked, CASE WHEN COALESCE(y.n, 0) > 0 THEN COALESCE(x.n, 0) - COALESCE(x.k, 0) ELSE 0 END code_only, CASE WHEN COALESCE(y.n, 0) = 0 THEN COALESCE(x.n, 0) ELSE 0 END unassessable, COALESCE(y.n, 0) - COALESCE(y.k, 0) prose_only FROM x FULL JOIN y USING (run)"""),
    "j2_silent": Query(lambda s, d: (lambda a, b, l: spans.silent(a, l))(*turns(s, d)), f"WITH {TURN_SQL} SELECT run, id FROM d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.run = d.run AND l.decision_id = d.id)"),
    "a21_coverage": Query(lambda s, d: spans.coverage(two_spans(s, d)[0]), f'WITH {SPAN_SQL}, p AS (SELECT run, kind, count(*) spans, sum("end" - "start" + 1)::BIGINT lines FROM a GROUP BY ALL) SELECT *, round(lines / sum(lines) OVER (PARTITION BY run), 6) AS share FROM p'),
    "j10_overlaps": Query(lambda s, d: spans.overlaps(*two_spans(s, d)), f"WITH {SPAN_SQL}{OVERLAP_SQL} SELECT run, i, j, n, jaccard, round(n / 8, 6) containment, 16 - 2 * n AS jitter FROM p"),
    "j9_first_span": Query(lambda s, d: spans.first_span(table(s, d, "documents").select(F.col("doc_id").alias("run"), (F.col("n_chars") % 70).alias("line")), two_spans(s, d)[0]).fillna(-1, ["span"]), f'WITH {SPAN_SQL} SELECT doc_id run, n_chars % 70 AS line, COALESCE(min(id), -1) span FROM documents LEFT JOIN a ON a.run = doc_id AND n_chars % 70 >= "start" AND n_chars % 70 <= "end" GROUP BY ALL'),
    "p_partition_audit": Query(lambda s, d: spans.partition_audit(two_spans(s, d)[1], table(s, d, "documents").select(F.col("doc_id").alias("run"), F.lit(60).alias("n"))), f"""WITH {SPAN_SQL}, k AS (SELECT run, line, count(*) k FROM (SELECT run, unnest(range("start", "end" + 1)) line FROM b) GROUP BY ALL)
        SELECT run, 60 - count(*) FILTER (line BETWEEN 1 AND 60) gaps, count(*) FILTER (k > 1) shared, count(*) FILTER (line NOT BETWEEN 1 AND 60) beyond FROM k GROUP BY run"""),
    "j11_greedy": Query(lambda s, d: spans.greedy(spans.overlaps(*two_spans(s, d)), "jaccard", 0.2)),  # the order decides; tests/test_forks.py has its cases
    "a37_span_f1": Query(lambda s, d: (lambda a, b: spans.f1(spans.greedy(spans.overlaps(a, b), "jaccard", 0.5), a, b))(*two_spans(s, d)), f"WITH {SPAN_SQL}{OVERLAP_SQL}, m AS (SELECT count(*) m FROM p WHERE jaccard >= 0.5), t AS (SELECT count(*) n FROM a) SELECT m, round(m / n, 6) AS precision, round(m / n, 6) recall, round(CASE WHEN m > 0 THEN 2 * (m / n) * (m / n) / (m / n + m / n) ELSE 0.0 END, 6) f1 FROM m, t"),
    "a37_levels": Query(lambda s, d: spans.f1_levels(*two_spans(s, d)), f"""WITH {SPAN_SQL}, l AS (SELECT * FROM (VALUES ('verbatim', 0), ('strict', 0), ('lenient', 2), ('core', 4)) t("level", most)), n AS (SELECT count(*) * 6 t FROM s), m AS (SELECT "level", sum(CASE WHEN shift <= most THEN 6 WHEN "level" = 'core' AND shift = 6 THEN 5 ELSE 0 END)::BIGINT m, sum(CASE WHEN shift BETWEEN 1 AND most THEN 6 WHEN "level" = 'core' AND shift = 6 THEN 5 ELSE 0 END) moved FROM l, s GROUP BY "level")
        SELECT "level", m, round(m / t, 6) AS precision, round(m / t, 6) recall, round(CASE WHEN m > 0 THEN m / t ELSE 0 END, 6) f1, round(CASE WHEN m > 0 THEN moved / m ELSE 0 END, 6) jitter_share FROM m, n"""),
    "a21_subtypes": Query(lambda s, d: spans.subtypes(two_spans(s, d)[0].withColumn("subtype", F.when(F.col("id") == 0, "import").otherwise("print"))), f"""WITH {SPAN_SQL} SELECT run, CASE WHEN id = 0 THEN 'import' ELSE 'print' END subtype, sum("end" - "start" + 1)::BIGINT AS lines FROM a WHERE kind = 'intron' GROUP BY ALL"""),
    "g2_components": Query(lambda s, d: cluster.connected(type_edges(s, d)), f"WITH {CHOICE_SQL}, f AS (SELECT DISTINCT fork, split_part(fork, '/', 1) AS type FROM choice) SELECT fork id, min(fork) OVER (PARTITION BY type) component FROM f QUALIFY count(*) OVER (PARTITION BY type) > 1"),
    "g7_threshold_split": Query(lambda s, d: cluster.threshold_split(cutoffs(s, d)).select("oid", "did", F.array_join(F.col("part").cast("array<string>"), ",").alias("part")), """WITH m AS (SELECT p_brand oid, p_partkey did, CASE p_size % 5 WHEN 0 THEN [] WHEN 1 THEN [(p_size % 3)::DOUBLE] WHEN 2 THEN [(p_size % 3)::DOUBLE, 5.0] WHEN 3 THEN [5.0] ELSE [(p_size % 3)::DOUBLE, 5.0, 9.0] END v FROM part),
        s AS (SELECT oid, v, count(*) n FROM m WHERE len(v) > 0 GROUP BY ALL), w AS (SELECT x.oid, x.v, y.v h FROM s x JOIN s y ON x.oid = y.oid AND len(x.v) < len(y.v) AND list_has_all(y.v, x.v)), h AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.oid = s.oid AND w.v = s.v)),
        f AS (SELECT w.oid, w.v, w.h FROM w JOIN h ON h.oid = w.oid AND h.v = w.h QUALIFY row_number() OVER (PARTITION BY w.oid, w.v ORDER BY -len(w.h), w.h) = 1), p AS (SELECT s.oid, s.v, COALESCE(f.h, s.v) AS part, n FROM s LEFT JOIN f ON f.oid = s.oid AND f.v = s.v),
        g AS (SELECT oid, part, sum(n) n FROM p GROUP BY ALL), z AS (SELECT oid, part FROM g QUALIFY row_number() OVER (PARTITION BY oid ORDER BY n DESC, -len(part), part) = 1)
        SELECT m.oid, did, array_to_string([x::VARCHAR FOR x IN COALESCE(p.part, z.part, [])], ',') AS part FROM m LEFT JOIN p ON p.oid = m.oid AND p.v = m.v LEFT JOIN z ON z.oid = m.oid"""),
    "g13_repeat_split": Query(lambda s, d: cluster.repeat_split(sequence.islands(events_choice(s, d))), f"""WITH {EVENTS_SQL}, g AS (SELECT *, COALESCE(line - lag(line) OVER w > 5, false)::INT gap FROM choice WINDOW w AS (PARTITION BY run, fork, option ORDER BY line, did)), o AS (SELECT did, run, fork, option, sum(gap) OVER (PARTITION BY run, fork, option ORDER BY line, did ROWS UNBOUNDED PRECEDING)::BIGINT k FROM g)
        SELECT did, run, fork, CASE WHEN k > 0 THEN option || ' #' || (k + 1)::VARCHAR ELSE option END AS option FROM o"""),
    "g9_relabel": Query(lambda s, d: forks.reach(cluster.relabel(orders_choice(s, d), type_edges(s, d).select(F.col("a").alias("fork"), F.col("type").alias("head")).union(type_edges(s, d).select("b", "type")).distinct())), f"""WITH {CHOICE_SQL}, f AS (SELECT DISTINCT fork, split_part(fork, '/', 1) AS type FROM choice), h AS (SELECT fork, type head FROM f QUALIFY count(*) OVER (PARTITION BY type) > 1)
        SELECT COALESCE(head, c.fork) AS fork, count(DISTINCT run) runs FROM choice c LEFT JOIN h USING (fork) GROUP BY 1"""),
    "g14_disputed": Query(lambda s, d: cluster.meet_disputed(table(s, d, "part").select("p_brand", "p_type"), "p_brand", "p_type"), "SELECT p_brand, count(*) parts, round(max(n) / sum(n), 6) largest FROM (SELECT p_brand, p_type, count(*) n FROM part GROUP BY ALL) GROUP BY p_brand HAVING count(*) > 1"),
    "a23_partition_counts": Query(lambda s, d: audit.partition_counts(orders_choice(s, d).select(F.col("option").alias("group"), "did").filter("did % 7 <> 0"), orders_choice(s, d).select("did")), f"""WITH {CHOICE_SQL}, m AS (SELECT option g, did FROM choice WHERE did % 7 <> 0)
        SELECT (SELECT count(DISTINCT did) FROM choice WHERE did NOT IN (SELECT did FROM m)) missing, (SELECT count(*) FROM (SELECT did FROM m GROUP BY did HAVING count(*) > 1)) duplicated, count(*) "groups", count(*) FILTER (n = 1) singletons, round(sum(n) / count(*), 6) compression FROM (SELECT g, count(*) n FROM m GROUP BY g)"""),
    "a_integrity": Query(integrity, f"""WITH {CHOICE_SQL}, m AS (SELECT did FROM choice WHERE did % 7 <> 0 UNION ALL SELECT did + 1000000000000 FROM choice WHERE did % 97 = 0), n AS (SELECT DISTINCT fork FROM choice WHERE fork <> 'PROMO' UNION ALL SELECT 'NO SUCH'), f AS (SELECT DISTINCT fork FROM choice)
        SELECT (SELECT count(DISTINCT did) FROM m WHERE did >= 1000000000000) dangling, (SELECT round(avg((did % 7 = 0)::INT), 6) FROM choice) unassigned, (SELECT count(*) FROM (SELECT fork FROM n EXCEPT SELECT fork FROM f UNION ALL (SELECT fork FROM f EXCEPT SELECT fork FROM n))) apart"""),
    "s6_floors": Query(lambda s, d: audit.floors(measured(s, d), s.createDataFrame([*audit.STABILITY_FLOORS.items()], "name string, least double")).select("name", F.round("value", 6).alias("value"), "verdict"), """WITH m AS (SELECT 'option_ari' AS name, avg(p_size) / 50 AS value FROM part UNION ALL SELECT 'fork_ari', count(DISTINCT p_brand) / 25 FROM part UNION ALL SELECT 'b_cubed', avg((p_size > 5)::INT) FROM part UNION ALL SELECT 'rho', avg((p_size > 25)::INT) FROM part),
        l AS (SELECT * FROM (VALUES ('option_ari', 0.85), ('fork_ari', 0.75), ('b_cubed', 0.80), ('lenient_f1', 0.70), ('judge', 0.75), ('rho', 0.85), ('residue', 0.70)) t(name, least_value)) SELECT name, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'INFO' WHEN value >= least_value THEN 'PASS' ELSE 'REVIEW' END verdict FROM l LEFT JOIN m USING (name)"""),
    "s9_checksums": Query(checksums, "SELECT * FROM (VALUES ('nation.parquet', 'changed'), ('region.parquet', 'ok'), ('gone.parquet', 'missing'), ('nation.parquet.new', 'missing')) t(path, state) WHERE path <> 'nation.parquet.new' UNION ALL SELECT 'orders.parquet', 'untracked'"),
    "m1_levels": Query(lambda s, d: surrogate.reached(orders_choice(s, d))[1], f"""WITH {CHOICE_SQL}{STATS}, c AS (SELECT * FROM choice), f AS (SELECT fork, run, option FROM c QUALIFY row_number() OVER (PARTITION BY fork, run ORDER BY line, did) = 1),
        n AS (SELECT fork, option FROM f GROUP BY ALL HAVING count(*) >= 10), r AS (SELECT DISTINCT run FROM c), l AS (SELECT f.fork, f.run, COALESCE(n.option, 'other') AS "level" FROM f LEFT JOIN n ON f.fork = n.fork AND f.option = n.option),
        e AS (SELECT t.fork, COALESCE("level", 'absent') AS "level", count(*) runs FROM (SELECT DISTINCT fork FROM n) t CROSS JOIN r LEFT JOIN l ON l.fork = t.fork AND l.run = r.run GROUP BY ALL) SELECT * FROM e WHERE fork IN (SELECT fork FROM e WHERE runs >= 10 GROUP BY fork HAVING count(*) >= 2)"""),
    "m6_strengths": Query(surrogate_strengths),
    "m5_cross_validation": Query(cross_validation),
    "n8_payout_null": Query(surrogate_null),
    "m7_audit": Query(surrogate_audit),
    "n1_bootstrap": on_orders(lambda c: resample.bootstrap_mean(forks.run_novelty(c), "score", "run", 4000), None),
    "n1_difference": on_orders(lambda c: resample.bootstrap_difference(forks.run_novelty(c), "decisions", "run", F.col("arm") == "BUILDING", 2000), None),
    "n2_curveball": Query(curveballs),
    "n4_return_null": Query(lambda s, d: resample.return_rate_null(sequence.spaced(events_choice(s, d)), 200)),
    "n7_arm_edges": Query(arm_edges),
    "n7_exact": Query(lambda s, d: tables.arm_edges(walked(s, d))),
    "st_sessions": Query(streamed_sessions, SESSIONS_SQL),
    "st_islands": Query(streamed_islands, ISLANDS_SQL),
    "st_islands_batch": Query(lambda s, d: islands.timed_islands(events_choice(s, d), VISIT_GAP), ISLANDS_SQL),
    "st_fork_stats": Query(streamed_stats, f"WITH {EVENTS_SQL}{STATS} SELECT * FROM stats"),
    "st_windows": Query(streamed_windows, f"WITH {EVENTS_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS start, fork, count(*) n FROM choice GROUP BY ALL"),
    "st_sessions_batch": Query(lambda s, d: incremental.sessions(table(s, d, "events")), SESSIONS_SQL),
}


def _alike(spark, sf_dir):
    """Items of benchmark that share a word which two to five of them have, with their texts."""
    b = table(spark, sf_dir, "benchmark")
    t = b.select("item_id", F.explode(text.words(F.col("text"))).alias("w"))
    rare = t.groupBy("w").agg(F.count("*").alias("n")).filter("n between 2 and 5").select("w")
    t = t.join(rare, "w")
    pairs = t.select("w", F.col("item_id").alias("a")).join(t.select("w", F.col("item_id").alias("b")), "w").filter("a < b").select("a", "b").distinct()
    return pairs.join(b.select(F.col("item_id").alias("a"), F.col("text").alias("x")), "a").join(b.select(F.col("item_id").alias("b"), F.col("text").alias("y")), "b")


def sentences(spark, sf_dir):
    """Sentences about parts that hit each branch of the predicates: id, t, note, cut."""
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), (F.col("p_partkey") % n + 1).cast("int"))
    t = F.concat(pick(6, "drop the ", "do not use the ", "never fit the ", "exclude no ", "no weights for ", "without using the "), F.col("p_name"), pick(4, " and then log it, with care", F.concat(F.lit(" or a "), F.col("p_type")), " (one / two)", ""))
    note = pick(4, "Results are consistent", "an inconsistent rule", "they differ", "No material difference")
    level, half = (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 5).cast("string")
    cut = F.concat(F.lit("keep rows where the score is "), pick(3, ">= ", "> ", "< "), level, F.lit(" for all of the raters who answered and age cutoff "), half, F.lit(".5; the interval is then given as 95% CI at 1.96"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_partkey", t.alias("t"), note.alias("note"), cut.alias("cut"))


def word_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    n = p.agg(F.countDistinct("p_partkey").alias("n"))
    t = p.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    return t.select("w", "df", *[F.round(text.idf(F.col("n"), F.col("df"), k), 6).alias(k) for k in ("idf", "smooth", "inverse")])
