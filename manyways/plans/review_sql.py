"""Queries on human review, with the SQL that must agree. Suppliers' residues are raters, parts items; a rater's vote on a part is that of
the largest line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.functions import text
from manyways.model import CHOICE_SQL, Query, on_orders, orders_choice, table
from manyways.operators import forks, review
from manyways.plans.members_sql import NUMBERED_SQL, numbered

VOTES_SQL = """WITH votes AS (SELECT (l_suppkey % 7)::BIGINT rater, l_partkey item, CASE max(l_returnflag || l_linestatus) WHEN 'NF' THEN 'same' WHEN 'NO' THEN 'same' WHEN 'RO' THEN 'different' WHEN 'RF' THEN 'unsure' ELSE 'different' END verdict, (max(l_quantity)::BIGINT % 5 + 1) confidence FROM lineitem GROUP BY ALL),
meta AS (SELECT p_partkey item, ['stable_same', 'stable_diff', 'unstable'][p_size % 3 + 1] stratum, p_partkey % 3 <> 0 model_a, p_size % 4 <> 0 model_b FROM part),
ia AS (SELECT item, sum(k * (k - 1) / 2) agree, sum(k) * (sum(k) - 1) / 2 pairs, sum(CASE WHEN verdict <> 'unsure' THEN k * (k - 1) / 2 ELSE 0 END) sure_agree, sum(CASE WHEN verdict <> 'unsure' THEN k ELSE 0 END) s FROM (SELECT item, verdict, count(*) k FROM votes GROUP BY ALL) GROUP BY item),
ov AS (SELECT stratum, count(*) items, round(avg(agree / pairs) FILTER (pairs > 0), 6) strict, round(avg(sure_agree / (s * (s - 1) / 2)) FILTER (s > 1), 6) committed, round(sum(agree) / sum(pairs), 6) strict_pooled, round(sum(sure_agree) / sum(s * (s - 1) / 2), 6) committed_pooled FROM ia JOIN meta USING (item) GROUP BY stratum),
z AS (SELECT *, CASE WHEN stddev_samp(confidence) OVER (PARTITION BY rater) > 0 THEN (confidence - avg(confidence) OVER (PARTITION BY rater)) / stddev_samp(confidence) OVER (PARTITION BY rater) ELSE 0 END z FROM votes),
gold AS (SELECT item, CASE WHEN stratum = 'stable_same' THEN 'same' ELSE 'different' END want FROM meta WHERE model_a AND model_b),
bad AS (SELECT item FROM votes JOIN gold USING (item) WHERE verdict <> 'unsure' GROUP BY item HAVING count(*) FILTER (verdict <> want) * 2 >= count(*)),
live AS (SELECT * FROM gold WHERE item NOT IN (SELECT item FROM bad)), maj AS (SELECT item, CASE WHEN count(*) FILTER (verdict = 'same') > count(*) FILTER (verdict = 'different') THEN 'same' ELSE 'different' END human FROM votes GROUP BY item HAVING count(*) FILTER (verdict = 'same') <> count(*) FILTER (verdict = 'different'))
"""


def votes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    t = line.groupBy((F.col("l_suppkey") % 7).alias("rater"), F.col("l_partkey").alias("item")).agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("f"), F.max("l_quantity").cast("long").alias("q"))
    verdict = F.when(F.col("f").isin("NF", "NO"), "same").when(F.col("f") == "RF", "unsure").otherwise("different")
    return t.select("rater", "item", verdict.alias("verdict"), (F.col("q") % 5 + 1).alias("confidence"))


def meta(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stratum = F.element_at(F.array(*map(F.lit, ("stable_same", "stable_diff", "unstable"))), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("item"), stratum.alias("stratum"), (F.col("p_partkey") % 3 != 0).alias("model_a"), (F.col("p_size") % 4 != 0).alias("model_b"))


def gold(spark, sf_dir):
    return meta(spark, sf_dir).filter("model_a and model_b").select("item", F.when(F.col("stratum") == "stable_same", "same").otherwise("different").alias("want"))


def careful(spark, sf_dir):
    """votes in which three raters know the gold items."""
    t = votes(spark, sf_dir).join(gold(spark, sf_dir), "item", "left")
    return t.withColumn("verdict", F.when((F.col("rater") <= 2) & F.col("want").isNotNull(), F.col("want")).otherwise(F.col("verdict"))).drop("want")


def pools(spark, sf_dir, narrow):
    m = meta(spark, sf_dir)
    n = m.groupBy("stratum").agg(F.count("*").alias("n"))
    if narrow:
        n = n.withColumn("n", F.when(F.col("stratum") == "stable_diff", F.lit(1).cast("long")).when(F.col("stratum") == "unstable", F.col("n") * 5).otherwise(F.col("n")))
    rate = m.groupBy("stratum").agg(F.avg((F.col("model_a") == F.col("model_b")).cast("double")).alias("rate"))
    return review.pool_weighted(review.overall(votes(spark, sf_dir), m), n, rate)


POOL_SQL = ", n AS (SELECT stratum, {n} n FROM meta GROUP BY stratum), r AS (SELECT stratum, avg((model_a = model_b)::INT) rate FROM meta GROUP BY stratum), w AS (SELECT sum(n * committed) / sum(n) h, sum(n * rate) / sum(n) m, sum(n) FILTER (stratum = 'stable_same') s, sum(n) FILTER (stratum = 'unstable') u FROM n JOIN ov USING (stratum) JOIN r USING (stratum))"


def flags(spark, sf_dir):
    c = orders_choice(spark, sf_dir).filter("did % 50 = 3")
    return c.select("fork", F.when(F.col("did") % 150 == 3, F.concat(F.lit("merge with "), F.col("option"))).alias("instruction"))


def two_options(spark, sf_dir):
    """Decisions with their forks and options in two builds."""
    c = numbered(spark, sf_dir).filter("fork like '%/%'")
    return c.select(F.col("did").alias("item"), "fork", F.col("option").alias("option_a"), F.substring("option", 1, 7).alias("option_b"))


def part_options(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") - F.lit(1)).alias("at"), F.concat_ws(" ", "p_name", "p_type").alias("label_a"), F.col("p_brand").alias("label_b"))


def part_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 3).cast("string")), " "))
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("option"), F.col("p_partkey").alias("item"), words.alias("words"))


def scored(spark, sf_dir):
    c = table(spark, sf_dir, "part")
    return c.select(F.col("p_brand").alias("fork"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("score"))


QUERIES = {
    "a42_item_agreement": Query(lambda s, d: review.item_agreement(votes(s, d)), VOTES_SQL + "SELECT item, pairs::BIGINT pairs, agree::BIGINT agree, (s * (s - 1) / 2)::BIGINT sure_pairs, sure_agree::BIGINT sure_agree FROM ia"),
    "a42_overall": Query(lambda s, d: review.overall(votes(s, d), meta(s, d).select("item", "stratum")), VOTES_SQL + "SELECT * FROM ov"),
    "a42_by_raters": Query(lambda s, d: review.by_raters(votes(s, d)), VOTES_SQL + "SELECT x.rater a, y.rater b, count(*) items, round(avg((x.verdict = y.verdict)::INT), 6) agree FROM votes x JOIN votes y ON x.item = y.item AND x.rater < y.rater GROUP BY ALL"),
    "a42_rater_z": Query(lambda s, d: review.rater_z(votes(s, d)).withColumn("z", F.round("z", 6)), VOTES_SQL + "SELECT rater, item, verdict, confidence, round(z, 6) z FROM z"),
    "a42_auc": Query(lambda s, d: review.auc(votes(s, d).join(meta(s, d).select("item", "model_a"), "item"), "confidence", "model_a", "rater"), VOTES_SQL + """, r AS (SELECT rater, model_a, rank() OVER (PARTITION BY rater ORDER BY confidence) + (count(*) OVER (PARTITION BY rater, confidence) - 1) / 2 r FROM votes JOIN meta USING (item))
        SELECT rater, round((sum(r) FILTER (model_a) - count(*) FILTER (model_a) * (count(*) FILTER (model_a) + 1) / 2) / (count(*) FILTER (model_a) * count(*) FILTER (NOT model_a)), 6) auc FROM r GROUP BY rater"""),
    "x14_sound_gold": Query(lambda s, d: review.sound_gold(votes(s, d), gold(s, d)), VOTES_SQL + "SELECT * FROM live"),
    "x14_sound_votes": Query(lambda s, d: review.sound_votes(careful(s, d), gold(s, d)).groupBy("rater").agg(F.count("*").alias("n")), VOTES_SQL + """, v AS (SELECT rater, votes.item, CASE WHEN rater <= 2 AND want IS NOT NULL THEN want ELSE verdict END verdict FROM votes LEFT JOIN gold ON gold.item = votes.item), b AS (SELECT item FROM v JOIN gold USING (item) WHERE verdict <> 'unsure' GROUP BY item HAVING count(*) FILTER (verdict <> want) * 2 >= count(*))
        SELECT rater, count(*) n FROM v WHERE rater NOT IN (SELECT rater FROM v JOIN gold USING (item) WHERE item NOT IN (SELECT item FROM b) AND verdict <> 'unsure' AND verdict <> want) GROUP BY rater"""),
    "x15_stable_gap": Query(lambda s, d: review.stable_gap(review.overall(votes(s, d), meta(s, d).select("item", "stratum"))), VOTES_SQL + ", t AS (SELECT sum(committed * items) FILTER (stratum <> 'unstable') / sum(items) FILTER (stratum <> 'unstable') a, max(committed) FILTER (stratum = 'unstable') u FROM ov) SELECT round(a, 6) stable, round(u, 6) unstable, round(a - u, 6) gap FROM t"),
    "x16_pool": Query(lambda s, d: pools(s, d, False), VOTES_SQL + POOL_SQL.format(n="count(*)") + " SELECT round(h, 6) human, false restricted, round(m, 6) model, round(m - h, 6) gap, NULL::DOUBLE jaccard FROM w"),
    "x16_restricted_pool": Query(lambda s, d: pools(s, d, True), VOTES_SQL + POOL_SQL.format(n="CASE stratum WHEN 'stable_diff' THEN 1 WHEN 'unstable' THEN 5 * count(*) ELSE count(*) END") + " SELECT round(h, 6) human, true restricted, NULL::DOUBLE model, NULL::DOUBLE gap, round(s / (s + u), 6) jaccard FROM w"),
    "x17_against_builds": Query(lambda s, d: review.against_builds(votes(s, d), meta(s, d)), VOTES_SQL + """, t AS (SELECT stratum, count(*) n, count(*) FILTER ((human = 'same') = model_a) a, count(*) FILTER ((human = 'same') = model_b) b, count(*) FILTER ((human = 'same') <> model_a AND (human = 'same') <> model_b) x FROM maj JOIN meta USING (item) GROUP BY stratum),
        e AS (SELECT *, unnest(range(0, n + 1)) i FROM t), f AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) p, exp(lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) - n * ln(2)) pa, exp(lgamma(n + 1) - lgamma(b + 1) - lgamma(n - b + 1) - n * ln(2)) pb FROM e)
        SELECT stratum, n items, a with_a, round(least(1, sum(p) FILTER (p <= pa + 1e-12)), 9) p_a, b with_b, round(least(1, sum(p) FILTER (p <= pb + 1e-12)), 9) p_b, x against_both FROM f GROUP BY ALL"""),
    "x18_hardest": Query(lambda s, d: review.hardest(votes(s, d)), VOTES_SQL + ", t AS (SELECT item, count(*) n, avg(z) z FROM z GROUP BY item) SELECT item, round(1 - sure_agree / (s * (s - 1) / 2) - z / 4, 6) difficulty FROM t JOIN ia USING (item) WHERE n >= 2 AND s > 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "x18_unjudgeable": Query(lambda s, d: review.unjudgeable(votes(s, d)), VOTES_SQL + "SELECT item, count(*) raters FROM votes GROUP BY item HAVING bool_and(verdict = 'unsure')"),
    "x19_queue": Query(lambda s, d: review.remerge_queue(flags(s, d), forks.reach(orders_choice(s, d))), f"WITH {CHOICE_SQL}, f AS (SELECT fork, count(*) FILTER (did % 150 = 3) instructions, count(*) flags FROM choice WHERE did % 50 = 3 GROUP BY fork), r AS (SELECT fork, count(DISTINCT run) runs FROM choice GROUP BY fork) SELECT fork, instructions, flags, runs, row_number() OVER (ORDER BY instructions DESC, flags DESC, runs DESC, fork) place FROM f JOIN r USING (fork)"),
    "x19_terms": Query(lambda s, d: review.recurring_terms(table(s, d, "part").select(F.col("p_brand").alias("fork"), F.concat_ws(" ", "p_name", F.lit("the is 12")).alias("text"))), "WITH t AS (SELECT DISTINCT p_brand, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS token FROM part) SELECT token, count(*) forks FROM t WHERE length(token) > 2 GROUP BY token HAVING count(*) >= 2"),
    "x12_option_pairs": Query(lambda s, d: review.option_pairs(two_options(s, d)), f"""WITH {CHOICE_SQL}, {NUMBERED_SQL}, t AS (SELECT did item, fork, option oa, substr(option, 1, 7) ob, row_number() OVER (PARTITION BY fork ORDER BY did) n FROM num WHERE fork LIKE '%/%')
        SELECT x.item a, y.item b, CASE WHEN x.oa = y.oa AND x.ob = y.ob THEN 'stable_same' WHEN x.oa <> y.oa AND x.ob <> y.ob THEN 'stable_diff' ELSE 'unstable' END stratum FROM t x JOIN t y ON x.fork = y.fork AND y.n BETWEEN x.n + 1 AND x.n + 11"""),
    "x12_hard_negatives": Query(lambda s, d: review.hard_negatives(part_options(s, d)), """WITH t AS (SELECT p_partkey - 1 AS at, p_name || ' ' || p_type la, p_brand lb, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) w FROM part WHERE p_partkey - 1 < 300)
        SELECT x.at a, y.at b FROM t x JOIN t y ON x.at < y.at WHERE x.la <> y.la AND x.lb <> y.lb AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) > 0.25"""),
    "x13_gold_pairs": Query(lambda s, d: review.gold_pairs(part_words(s, d)), """WITH t AS (SELECT p_brand || '/' || p_type AS option, p_partkey item, list_distinct(string_split(p_name || ' ' || p_type || ' ' || (p_size % 3)::VARCHAR, ' ')) w FROM part),
        p AS (SELECT x.option, x.item a, y.item b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) jaccard FROM t x JOIN t y ON x.option = y.option AND x.item < y.item) SELECT * FROM p WHERE jaccard >= 0.6 QUALIFY row_number() OVER (PARTITION BY option ORDER BY jaccard DESC, a, b) = 1"""),
    "k5_worst_and_random": Query(lambda s, d: review.worst_and_random(scored(s, d), 30, F.col("item") * 7919 % 10007), """WITH t AS (SELECT p_brand AS fork, p_partkey item, p_retailprice score FROM part), w AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY fork ORDER BY score DESC, item) = 1 ORDER BY score DESC, item LIMIT 15),
        r AS (SELECT * FROM t WHERE item NOT IN (SELECT item FROM w) ORDER BY item * 7919 % 10007, item LIMIT 15) SELECT fork, item, 'worst' drawn FROM w UNION ALL SELECT fork, item, 'random' FROM r"""),
    "k1_exhibits": Query(lambda s, d: review.exhibits(table(s, d, "part").select(F.col("p_brand").alias("check"), "p_partkey", "p_size"), [F.desc("p_size"), F.asc("p_partkey")]), 'SELECT * FROM (SELECT p_brand AS "check", p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS "of" FROM part) WHERE rank <= 5'),
}
