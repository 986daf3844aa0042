"""Pipeline stages over tables whose further columns clash with names that the stages use themselves."""

import corpus_pipeline as p

SAME = "one two three four five six seven eight nine ten"
TEXTS = [(1, SAME), (2, SAME), (3, None), (4, ""), (5, "another text of some more words than five"), (5, "under the same id stands quite another text")]
CLASHING = ["quality_score", "Row_Number", "_quality", "_row", "_id", "score", "copies", "copy", "row", "piece", "length", "kept", "component_id", "set_id", "size", "its", "_text"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame([(i, t, "en", "a", *(f"{c}{i}" for c in CLASHING)) for i, t in TEXTS], schema)
    out = p.deduplicate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = sorted(((r.doc_id, r.text, r["_row"], r["Row_Number"]) for r in out.collect()), key=str)
    assert rows == sorted(((i, t, f"_row{i}", f"Row_Number{i}") for i, t in TEXTS if i != 2), key=str)
    unique = docs.filter("doc_id < 5")
    assert sorted(r.doc_id for r in p.deduplicate(spark, unique, str(tmp_path)).collect()) == [1, 3, 4]
    for stage in (p.classify, p.clean, p.mix):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r["_quality"] == f"_quality{r.doc_id}" and r["copies"] == f"copies{r.doc_id}" for r in out.collect())
    assert p.clean(spark, docs, str(tmp_path)).count() == len(TEXTS)
    pieces = p.pack(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in pieces) == [1, 2, 3, 4, 5, 5] and sum(r.length == 1 for r in pieces) == 2


def test_nothing_to_learn_keeps_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, SAME, "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert p.classify(spark, docs, str(tmp_path)).count() == 2
