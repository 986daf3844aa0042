"""Queries over replies with JSON in them, codebooks and review sheets, written as files from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from manyways.functions import text
from manyways.model import CHOICE_SQL, Query, orders_choice, table
from manyways.operators.cluster import shared
from manyways.sources import sheets

#: What stands around a value, by the remainder of its id; the last is cut off.
AROUND = (("", ""), ("```json\n", "\n``` and {more}"), ("Here it is [sic: ", " }] done"), ("See: ", ' or {"b": 1}'), ("\n  ", "\n\n"), ("", ""))


def replies(spark, sf_dir):
    """id, reply: each item's text in an object with brackets and quotes in its strings."""
    clean = F.regexp_replace("text", r"[\x22\\\s]+", " ")
    value = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit(', "odd": "}] \\" {[", "text": ["'), clean, F.lit('"]}'))
    k = F.col("item_id") % len(AROUND)
    around = lambda side: F.element_at(F.array(*[F.lit(x[side]) for x in AROUND]), (k + 1).cast("int"))
    cut = F.when(k == 5, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(around(0), cut, around(1)).alias("reply"))


JSON_SQL = """WITH t AS (SELECT item_id AS id, item_id % 6 AS k, '{"id": ' || item_id || ', "odd": "}] \\" {[", "text": ["' || regexp_replace(text, '["\\\\\\s]+', ' ', 'g') || '"]}' AS v FROM benchmark)
  SELECT id, CASE WHEN k = 2 THEN '[sic: ' || v || ' }' WHEN k <> 5 THEN v END AS value, CASE WHEN k = 5 THEN 'cut off' WHEN k = 2 THEN 'malformed' END AS fault FROM t"""


def books(spark, sf_dir):
    """Each run's last option at each fork as a codebook's file; runs are dealt to files of many lines."""
    last = orders_choice(spark, sf_dir).groupBy("run", "fork").agg(F.max_by("option", "line").alias("option"))
    fork = F.split("fork", "/")
    entry = F.struct(F.coalesce(F.get(fork, F.lit(1)), F.lit("any")).alias("slot"), F.struct(F.concat(F.lit(" "), "option").alias("choice_made"), F.lit(1).alias("line")).alias("v"))
    per = last.select("run", fork[0].alias("category"), entry.alias("e")).groupBy("run", "category").agg(F.map_from_entries(F.collect_list("e")).alias("slots"))
    per = per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("category", "slots"))).alias("m"))
    json = F.to_json(F.struct(F.col("m").alias("mapped_decisions"), F.array(F.struct(F.concat(F.lit("run "), F.col("run").cast("string")).alias("description"))).alias("unmapped_decisions")))
    at = f"{shared(spark)}/books-{uuid.uuid4().hex}"
    per.select(F.concat_ws("\t", F.col("run").cast("string"), json).alias("value")).write.text(at)
    return spark.read.text(at).select(F.substring_index("value", "\t", 1).cast("long").alias("run"), F.regexp_replace("value", r"\A[^\t]*\t", "").alias("content"))


def reviewed(spark, sf_dir):
    """A sheet of each priority: orders as pairs, with comments and front matter."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isNotNull())
    conf = F.element_at(F.array(*map(F.lit, ("High", "med", "2.5", "unsure"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    row = F.concat_ws(",", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_custkey") % 2 == 0, " Same").otherwise("different"), conf, F.lit('"a, ""b"""'))
    head = F.concat(F.lit("---\nround: "), F.col("o_orderpriority"), F.lit("\n---\n# by hand\n\npair_id,verdict,confidence,note\n"))
    # sheets are small: an hour's orders of a priority make one
    per = o.groupBy("o_orderpriority", F.date_trunc("hour", "o_orderdate").alias("hour"), F.pmod("o_orderkey", F.lit(64)).alias("part")).agg(F.concat(head, F.array_join(F.collect_list(row), "\n")).alias("content"))
    return sheets.review_sheets(per.select(F.concat_ws("/", "o_orderpriority", F.col("hour").cast("string"), F.col("part").cast("string")).alias("path"), "content"))


QUERIES = {
    "f_json": Query(lambda s, d: replies(s, d).select("id", text.json_value(F.col("reply")).alias("value"), text.json_fault(F.col("reply")).alias("fault")), JSON_SQL),
    "x21_codebook": Query(lambda s, d: sheets.codebook(books(s, d)), f"WITH {CHOICE_SQL} SELECT run, CASE WHEN contains(fork, '/') THEN replace(fork, '/', '.') ELSE fork || '.any' END AS slot, arg_max(option, line) AS choice FROM choice GROUP BY run, fork"),
    "x21_unmapped": Query(lambda s, d: sheets.unmapped(books(s, d)), f"WITH {CHOICE_SQL} SELECT DISTINCT run, 'run ' || run::VARCHAR AS text FROM choice"),
    "x_review_sheets": Query(lambda s, d: reviewed(s, d).select("pair_id", F.col("meta")["round"].alias("round"), "verdict", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "note"), """SELECT 'o' || o_orderkey::VARCHAR AS pair_id, o_orderpriority AS round, CASE WHEN o_custkey % 2 = 0 THEN 'same' ELSE 'different' END AS verdict,
        [5.0, 3.0, 2.5, -1.0][(o_orderkey % 4 + 1)::INT]::DOUBLE AS confidence, 'a, "b"' AS note FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderpriority IS NOT NULL"""),
}
