"""JSON in replies against a loop and Python's own decoder, codebooks and review sheets from files."""

import json
import random

from pyspark.sql import functions as F

from manyways.functions import text
from manyways.sources import sheets

REPLIES = [
    '{"a": 1}', '```json\n{"a": "}"}\n``` after {', 'Sure, here: [1, {"b": "x\\"]"}] and {more}', "none here", '{"a": [1, 2', '{"a" 1}', None, "", '😀 {"é": "漢}😀"} {', "```\n[1]\n```",
    '  ```JSON {"k": "\\\\"} ```', '{"deep": [[[{"x": "[{\\"}"}]]]} trailing ]}', "{]", "text ] first {\"a\": null}", '{"open": "string', '{"long": "' + "x{[" * 5000 + '"}',
]


def by_loop(reply):
    t = (reply or "").lstrip()
    if t.startswith("```"):
        t = (t.split("```") + [""])[1]
        if t.lstrip().lower().startswith("json"):
            t = t.lstrip()[4:]
    starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
    if not starts:
        return None, "no JSON"
    t = t[min(starts) :]
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(t):
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                try:
                    json.loads(t[: i + 1])
                    return t[: i + 1], None
                except ValueError:
                    return t[: i + 1], "malformed"
    return None, "cut off"


def test_values_of_replies(spark):
    r = random.Random(1)
    some = [*REPLIES, *("".join(r.choice(['{', '}', '[', ']', '"', "\\", "a", ":", ",", " ", "1"]) for _ in range(r.randint(0, 18))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(some)), "i int, r string")
    got = {x.i: (x.v, x.f) for x in df.select("i", text.json_value(F.col("r")).alias("v"), text.json_fault(F.col("r")).alias("f")).collect()}
    for i, reply in enumerate(some):
        assert got[i] == by_loop(reply), reply


def test_codebook_from_files(spark, tmp_path):
    book = {"mapped_decisions": {"model": {"family": {"choice_made": " logit "}, "link": {"choice_made": ""}, "odd": "text", "none": {"choice_made": None}}, "data": {"unit": {"choice_made": 3, "more": [1]}}, "list": [1], "empty": {}}, "unmapped_decisions": [{"description": "kept"}, {"decision": "why"}, "plain", {"x": 1}]}
    for name, content in (("r1", json.dumps(book)), ("r2", "{}"), ("r3", "no json"), ("r4", json.dumps({"mapped_decisions": None}))):
        (tmp_path / name).write_text(content)
    files = sheets.whole_files(spark, str(tmp_path)).withColumn("run", F.element_at(F.split("path", "/"), -1))
    assert files.count() == 4
    assert sorted(map(tuple, sheets.codebook(files).collect())) == [("r1", "data.unit", "3"), ("r1", "model.family", "logit")]
    assert sorted(r.text for r in sheets.unmapped(files).collect()) == ["kept", "plain", "why", '{"x":1}']
    assert sheets.codebook(files.limit(0)).count() == 0


def test_review_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿---\nrater: 'Kim'\nround: 2\n# not: this\n---\n# a comment\n\n,,\npair_id,item,verdict,confidence,note\np1,\"x, y\",Same,High,\"a \"\"note\"\"\"\n# p9,x,same,5,\np2,z,different,2.5\np3,z,,low,\n,z,same,low,\np2,z, SAME ,what,again\n")
    (tmp_path / "b.csv").write_text("verdict,pair_id\nsame,p1\n")
    (tmp_path / "c.csv").write_text("other,columns\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    rows = {(r.path[-5:], r.pair_id): (r.meta, r.verdict, r.confidence, r.note) for r in sheets.review_sheets(sheets.whole_files(spark, str(tmp_path))).collect()}
    meta = {"rater": "Kim", "round": "2"}
    assert rows == {("a.csv", "p1"): (meta, "same", 5.0, 'a "note"'), ("a.csv", "p2"): (meta, "same", None, "again"), ("b.csv", "p1"): ({}, "same", None, "")}


def test_a_line_is_parsed_once(spark):
    files = spark.createDataFrame([("a", "pair_id,verdict\np1,same\n")], "path string, content string")
    plan = sheets.review_sheets(files)._jdf.queryExecution().optimizedPlan().toString()
    assert 2 <= plan.count("from_csv(") <= 2 * 2  # header and line; a filter may look once more
