"""The corpus pipeline: quality filter, near-duplicates, secrets, source mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm import mixing, neardup, packing, quality, secrets
from manyways.llm.common import table, written


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1; the labels come from the labels table. Null and empty texts have the share of label 1 among the
    learned labels as their score; where nothing can be learned all documents stay. Texts of any length are read whole; equal texts
    have equal scores, so repeated rows stay or go together; an empty table stays empty; further columns of any name are kept."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    score = unused(docs, "quality_score")
    return quality.scored(docs, model, score).filter(F.col(score) >= 0.7).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words a shingle, a similarity of 0.8 or more; the smallest doc_id stays. Rows equal
    in doc_id and text are one document, also where lang or source differ; rows that share a doc_id but not the text are several, of
    which the smaller hash of the text stays where they are alike. Every row without a doc_id stays, and every null, empty or wordless text
    under an id. Texts of any length are compared whole; an empty table stays empty; further columns of any name are kept."""
    row = unused(docs, "row_number")
    known = docs.filter("doc_id is not null")
    if not known.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).filter("kept").select(F.col("doc_id").alias(row)).distinct()
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept[row]), "left_semi")
    # numbers in the order of doc_id and text stand for the rows; the written table fixes them
    rows = written(known.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width=5, percent=80).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars, if there, set right. Null texts stay null, empty ones empty; long
    texts are scanned whole; repeated rows stay; an empty table stays empty; further columns of any name are kept."""
    return secrets.redact(docs, secrets.learn(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources come near their target shares of words. A null source is one of its own, the last;
    null, empty and wordless texts have no words but are repeated by their source's rate like others; equal doc_ids (null included) of one
    source share their luck. An empty table stays empty; further columns of any name are kept."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is its end id alone; longer texts than a sequence are
    cut into pieces; repeated rows are packed as often as they are there; an empty table gives no pieces; further columns play no part."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [("quality classifier", classify), ("MinHash near-dedup", deduplicate), ("secret scans", clean), ("mixing sources", mix), ("best-fit packing", pack)]

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again before the next. What each does with odd rows stands there."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
