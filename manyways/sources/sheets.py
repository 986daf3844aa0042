"""Codebooks and review sheets: nested JSON maps exploded to rows, and hand-edited CSV with comments or front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.functions import text

#: What words of confidence are worth.
CONFIDENCE = {"high": 5.0, "medium": 3.0, "med": 3.0, "low": 1.0}
MAPS = "map<string,string>"
COLUMNS = 32


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: each file as one text, as Spark's reader finds it; any store that Spark reads will do."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _entries(json: Column) -> Column:
    """Key and value (as text) of each entry of an object's text; none where it is no object."""
    return F.map_entries(F.from_json(F.when(F.ltrim(json).startswith("{"), json), MAPS))


def codebook(files: DataFrame) -> DataFrame:
    """run, slot, choice of files (run, content): content is a JSON object whose `mapped_decisions` has categories, each with slots, each with a
    `choice_made`. A slot's name is category.slot. Entries of another shape, and empty choices, are left out; a choice is trimmed. Where a
    file can't be read it gives no rows."""
    top = files.select("run", F.explode(_entries(F.get_json_object("content", "$.mapped_decisions"))).alias("category"))
    slots = top.select("run", F.col("category.key").alias("category"), F.explode(_entries(F.col("category.value"))).alias("slot"))
    choice = F.trim(F.get_json_object(F.when(F.ltrim("slot.value").startswith("{"), F.col("slot.value")), "$.choice_made"))
    return slots.select("run", F.concat_ws(".", "category", "slot.key").alias("slot"), choice.alias("choice")).filter("choice <> ''")


def unmapped(files: DataFrame) -> DataFrame:
    """run, text: `unmapped_decisions` of the same files, each by its description, else its decision, else as it stands."""
    each = files.select("run", F.explode(F.from_json(F.get_json_object("content", "$.unmapped_decisions"), "array<string>")).alias("d"))
    own = lambda k: F.nullif(F.get_json_object(F.when(F.ltrim("d").startswith("{"), F.col("d")), f"$.{k}"), F.lit(""))
    return each.select("run", F.coalesce(own("description"), own("decision"), "d").alias("text"))


def review_sheets(files: DataFrame) -> DataFrame:
    """path, meta, pair_id, verdict, confidence, note of sheets (path, content): CSV in which lines of `#` and blank ones don't count, the first
    other line names the columns, and front matter, if there, is given as a map. Rows without a pair_id or a verdict are left out; a verdict
    is lower case; confidence is a number or a word that CONFIDENCE knows, null else. A sheet without these two columns gives no rows.
    Of a pair that comes twice in a sheet the last row counts. Fields hold no line breaks; COLUMNS are read."""
    body = text.without_front_matter(F.regexp_replace("content", "^﻿", ""))
    parsed = lambda line: F.from_csv(line, ", ".join(f"c{i} string" for i in range(COLUMNS)), {"escape": '"'})
    # a line is parsed once: as an array of its fields, behind an explode through which no filter takes the parser with it
    fields = lambda line: F.explode_outer(F.transform(F.array(parsed(line)), lambda x: F.array(*[x[f"c{i}"] for i in range(COLUMNS)])))
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"[^\s,]")) & ~F.regexp_like(x, F.lit(r"^\s*\x22?\s*#")))
    t = files.select("path", text.front_matter(F.regexp_replace("content", "^﻿", "")).alias("meta"), lines.alias("lines")).filter(F.size("lines") > 0)
    t = t.select("path", "meta", "lines", fields(F.col("lines")[0]).alias("names"))
    t = t.select("path", "meta", "names", F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("place", "line"))
    t = t.select("path", "meta", "place", "names", fields(F.col("line")).alias("values"))
    value = lambda name: F.trim(F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1))  # noqa: E731  null where the name isn't there
    word = F.lower(value("confidence"))
    number = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), word)
    t = t.select("path", "meta", "place", value("pair_id").alias("pair_id"), F.lower(value("verdict")).alias("verdict"), F.coalesce(number, word.try_cast("double")).alias("confidence"), F.coalesce(value("note"), F.lit("")).alias("note"))
    fine = t.filter("pair_id <> '' and verdict <> ''")
    last = fine.groupBy("path", "pair_id").agg(F.max_by(F.struct("meta", "verdict", "confidence", "note"), "place").alias("x"))
    return last.select("path", "x.meta", "pair_id", "x.verdict", "x.confidence", "x.note")
