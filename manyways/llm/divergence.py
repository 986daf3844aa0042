"""Source divergence audit: how far the term distributions of sources lie apart, and by which terms, in exact arithmetic."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyways.llm.common import table, trimmed, written

LEAST = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: A term is heavy if at least one in MANY of its language's groups have it.
MANY = 4
#: So many terms and groups, about, make a tile.
TERMS = 1024
GROUPS = 64
#: A worker adds up terms over so many bytes of text before it sends them.
FLUSH = 16_000_000

_letters = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, with only A-Z lower-cased."""
    return text.translate(_letters).split()


def counted(docs: DataFrame) -> DataFrame:
    """lang, term, docs, counts (source and n): partial sums of many documents each, to be added up."""
    schema = "lang string, term string, docs int, counts array<struct<source:string,n:int>>"

    def rows(held: dict[str, Counter], of: dict[tuple[str, str], Counter]):
        for lang, docs in held.items():
            own = [(s, c) for (x, s), c in of.items() if x == lang]
            words = [*docs]
            place = {w: i for i, w in enumerate(words)}
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in own])
            n = np.concatenate([np.fromiter(c.values(), np.int32, len(c)) for _, c in own])
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
            order = np.argsort(at, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(words)))))
            names = pa.array([s for s, _ in own], pa.string()).take(pa.array(source[order]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, pa.array(n[order])], ["source", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*docs.values()], pa.int32()), lists], ["lang", "term", "docs", "counts"])

    def each(batches):
        held, of, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = terms(text)
                if found:
                    of[lang, source].update(found)
                    held[lang].update({*found})
                size += len(text)
                if size > FLUSH:
                    yield from rows(held, of)
                    held, of, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(held, of)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(each), schema)


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n of the terms that at least `least` documents of the language hold. One shuffle, of partial sums: a term has as
    many rows as there are batches of documents, however frequent it is."""
    everywhere = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = counted(docs).withColumn("in_docs", everywhere).filter(F.col("in_docs") >= least)
    return kept.select("lang", "term", F.explode("counts").alias("c")).groupBy("lang", "c.source", "term").agg(F.sum("c.n").alias("n"))


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * v)), exact however large the counts are."""
    wide = lambda c: c.cast("decimal(22,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total + PRIOR * v)) + 1


def tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over a tile's terms of |p - q| - |a - b| for each pair of a left and a right group, where a and b are the shares of an absent
    term: so terms that neither has add nothing. Heavy terms fill dense rows. Light ones go by postings: first each posting against the
    other group's absent share, then a correction for the pairs that both have. Chunk 0 adds |a - b| for all terms."""
    seed = pdf["p"].isna().to_numpy()
    left, right = (pdf[seed & (pdf["side"] == s).to_numpy()].drop_duplicates("source") for s in "lr")
    a, b = left["absent"].to_numpy(np.int64), right["absent"].to_numpy(np.int64)
    apart = np.abs(a[:, None] - b[None, :])
    total = apart * int(pdf["v"].max()) if pdf["chunk"].iloc[0] == 0 else np.zeros_like(apart)
    number = [{s: i for i, s in enumerate(x["source"])} for x in (left, right)]
    sides = []
    for side, known in zip("lr", number, strict=True):
        x = pdf[~seed & (pdf["side"] == side).to_numpy()]
        sides.append((x["heavy"].to_numpy(bool), x["source"].map(known).to_numpy(np.int64), x["term"].to_numpy(object), x["p"].to_numpy(np.int64)))
    names = {t: i for i, t in enumerate(sorted({*sides[0][2], *sides[1][2]}))}
    codes = [np.array([names[t] for t in x[2]], np.int64) for x in sides]
    heavy = np.unique(np.concatenate([c[x[0]] for c, x in zip(codes, sides, strict=True)]))
    if len(heavy):
        dense = []
        for (is_heavy, group, _, p), c, absent in zip(sides, codes, (a, b), strict=True):
            d = np.repeat(absent[:, None], len(heavy), axis=1)
            d[group[is_heavy], np.searchsorted(heavy, c[is_heavy])] = p[is_heavy]
            dense.append(d)
        for i, row in enumerate(dense[0]):
            total[i] += np.abs(row[None, :] - dense[1]).sum(axis=1)
        total -= apart * len(heavy)
    (i, s, p), (j, t, q) = ((group[~is_heavy], c[~is_heavy], x[~is_heavy]) for (is_heavy, group, _, x), c in zip(sides, codes, strict=True))
    np.add.at(total, i, np.abs(p[:, None] - b[None, :]) - apart[i])
    np.add.at(total.T, j, np.abs(q[:, None] - a[None, :]) - apart.T[j])
    order = np.argsort(t, kind="stable")
    j, t, q = j[order], t[order], q[order]
    first, beyond = np.searchsorted(t, s), np.searchsorted(t, s, "right")
    n = beyond - first
    x = np.repeat(np.arange(len(s)), n)
    y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
    i, p, j, q = i[x], p[x], j[y], q[y]
    np.add.at(total, (i, j), np.abs(p - q) - np.abs(p - b[j]) - np.abs(q - a[i]) + apart[i, j])
    source, item = np.repeat(left["source"].to_numpy(object), len(right)), np.tile(right["source"].to_numpy(object), len(left))
    value = total.ravel()
    if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
        source, item, value = np.concatenate((source, item)), np.concatenate((item, source)), np.concatenate((value, value))
    other = source != item
    return pd.DataFrame({"lang": np.full(other.sum(), pdf["lang"].iloc[0], object), "source": source[other], "item": item[other], "value": value[other]})


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, many: int = MANY, chunk_terms: int = TERMS, block_groups: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language and the sum over kept terms of the distance of
    their shares. Part `term`: the `top` terms that a source has more often than its language does.

    Null text, lang and source are ''. A group without terms has the shares of absent terms only; where a language keeps no term all its
    pairs are 0 apart. Repeated rows count as often as they occur; ties go to the smaller item; an empty table gives no rows; other columns
    play no part; long texts are counted whole. Groups and terms are dealt in blocks, so no task holds all of a language.
    """
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text")))
    counts = written(kept_counts(rows, least), "terms")
    of_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.count("*").alias("held"))
    langs = of_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "total_lang")))
    members = groups.groupBy("lang").agg(F.count("*").alias("members"))
    blocks = (1 + F.floor((F.col("members") - 1) / block_groups)).cast("int")
    groups = groups.join(members, "lang").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = written(groups.withColumn("absent", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(0).cast("long")).withColumn("chunks", (1 + F.floor(F.greatest(F.col("v") - 1, zero) / chunk_terms)).cast("int")), "groups")

    shares = counts.join(groups, ["lang", "source"]).join(of_terms, ["lang", "term"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")).cast("long")).withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("v")).cast("long"))
    shares = written(shares.select("lang", "source", "term", "p", "q", (F.col("held") * many >= F.col("members")).alias("heavy"), "block", "blocks", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk")), "shares")

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    by_term = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", ranked).filter(F.col("rank") <= top)

    seeds = groups.select("lang", "source", "block", "blocks", "absent", "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    both = seeds.unionByName(shares.select("lang", "source", "term", "p", "heavy", "block", "blocks", "chunk"), allowMissingColumns=True)
    left = both.select("*", F.lit("l").alias("side"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = both.select("*", F.lit("r").alias("side"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    sums = left.unionByName(right).groupBy("lang", "chunk", "i", "j").applyInPandas(tile, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return pairs.unionByName(by_term)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
  kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
  groups AS (SELECT lang, source, COALESCE(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)),
  shares AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n,
      (1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 5)) // (g.total + 5 * v.v))::BIGINT AS p,
      (1 + (1000000000::HUGEINT * (sum(COALESCE(c.n, 0)) OVER (PARTITION BY g.lang, k.term) + 5)) // (sum(COALESCE(c.n, 0)) OVER (PARTITION BY g.lang) + 5 * v.v))::BIGINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, COALESCE(f, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
  SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
