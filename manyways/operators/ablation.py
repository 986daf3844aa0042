"""Code against prose: which runs can be compared, blinded answers brought back to (code, prose), tallies and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions.stats import spearman
from manyways.operators.cluster import stored
from manyways.operators.resample import uniform

GATE = 0.85
WHOLE = 40
VERDICTS = ("same_option", "vaguer", "same_fork_different_option")


def eligible(code: DataFrame, prose: DataFrame) -> DataFrame:
    """run, corpus, n_code, n_prose of runs that have decisions in both channels (run, corpus, id)."""
    n = lambda d, name: d.groupBy("run", "corpus").agg(F.count("*").alias(name))
    return n(code, "n_code").join(n(prose, "n_prose"), ["run", "corpus"])


def sampled(runs: DataFrame, share: float, whole: int = WHOLE, seed: int = 20260822, key: Column | None = None) -> DataFrame:
    """Of each corpus all runs if it has fewer than `whole`, else a share of them (one at least), by hash or a given order."""
    w = Window.partitionBy("corpus")
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(uniform("run", seed=seed) if key is None else key, "run"))
    t = runs.withColumn("_n", n).withColumn("_rank", rank)
    return t.filter((F.col("_n") < whole) | (F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0)))).drop("_n", "_rank")


def unblinded(answers: DataFrame) -> DataFrame:
    """answers (run, flipped, id_1, id_2, verdict) as run, flipped, code_id, prose_id, verdict: flipped ones had prose in the first list."""
    code, prose = F.when(F.col("flipped"), F.col("id_2")).otherwise(F.col("id_1")), F.when(F.col("flipped"), F.col("id_1")).otherwise(F.col("id_2"))
    return answers.select("run", "flipped", code.alias("code_id"), prose.alias("prose_id"), "verdict")


def answer_errors(pairs: DataFrame, code: DataFrame, prose: DataFrame) -> DataFrame:
    """run, problem, n of pairs (run, code_id, prose_id, verdict; a null id on the other side: unmatched): ids that no row accounts for, ids
    used more than once, ids that aren't there, unknown verdicts."""
    out = None
    for side, items in (("code", code), ("prose", prose)):
        used = pairs.select("run", F.col(f"{side}_id").alias("id")).dropna(subset=["id"]).groupBy("run", "id").agg(F.count("*").alias("k"))
        t = items.select("run", "id", F.lit(1).alias("there")).join(used, ["run", "id"], "full_outer")
        problem = F.when(F.col("k").isNull(), "missing").when(F.col("there").isNull(), "unknown").when(F.col("k") > 1, "repeated")
        part = t.select("run", F.concat(problem, F.lit(f" {side}")).alias("problem"))
        out = part if out is None else out.union(part)
    wrong = pairs.filter(F.col("code_id").isNotNull() & F.col("prose_id").isNotNull() & ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).select("run", F.lit("verdict").alias("problem"))
    return out.union(wrong).dropna().groupBy("run", "problem").agg(F.count("*").alias("n"))


def null_pairs(runs: DataFrame) -> DataFrame:
    """run, other: each run's code against the next run's prose of the same corpus, the last against the first; none in a corpus of one run."""
    w = Window.partitionBy("corpus").orderBy("run")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return runs.select("corpus", "run", F.coalesce(F.lead("run").over(w), F.first("run").over(whole)).alias("other")).filter("run <> other")


def per_run(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run of runs (run, corpus, flipped, n_code, n_prose): matched pairs by verdict, recall of code decisions and agreement."""
    count = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    m = pairs.groupBy("run").agg(F.count("*").alias("matched"), count(VERDICTS[0]).alias("same"), count(VERDICTS[1]).alias("vague"), count(VERDICTS[2]).alias("conflict"))
    t = runs.join(m, "run", "left").fillna(0, ["matched", "same", "vague", "conflict"])
    return t.withColumn("recall", F.when(F.col("n_code") > 0, F.col("matched") / F.col("n_code")).otherwise(0.0)).withColumn("agree", F.when(F.col("matched") > 0, F.col("same") / F.col("matched")).otherwise(0.0))


def tally(rows: DataFrame) -> DataFrame:
    """Recall, strict and lenient agreement, conflict and what each side has alone, of per_run() by corpus and of all together (corpus null)."""
    s = lambda c: F.sum(c).alias(c)
    t = rows.groupingSets([[F.col("corpus")], []], "corpus").agg(F.count("*").alias("runs"), s("n_code"), s("n_prose"), s("matched"), s("same"), s("vague"), s("conflict"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    c = F.col
    return t.select(
        "corpus", "runs", "n_code", "n_prose", "matched", share(c("matched"), c("n_code")).alias("recall"), share(c("same"), c("matched")).alias("strict"), share(c("same") + c("vague"), c("matched")).alias("lenient"),
        share(c("conflict"), c("matched")).alias("conflict"), (c("n_code") - c("matched")).alias("code_only"), (c("n_prose") - c("matched")).alias("prose_only"),
    )


def audited(rows: DataFrame, null: DataFrame) -> DataFrame:
    """check, verdict, value of per_run() within runs and over mismatched runs: E1 blinding, E2 leniency, E3 length, E4 each corpus,
    E5 spread over runs, E6 degenerate matching."""
    c = F.col
    one = rows.agg(F.sum("matched").alias("m"), F.sum("n_code").alias("n"), F.avg(c("flipped").cast("double")).alias("flipped"), F.max("matched").alias("most"))
    other = null.agg(F.sum("matched").alias("nm"), F.sum("n_code").alias("nn"))
    rho = spearman(rows, "n_prose", "recall").select("rho")
    worst = rows.groupBy("corpus").agg(F.sum("same").alias("s"), F.sum("matched").alias("k")).agg(F.min(F.when(c("k") > 0, c("s") / c("k")).otherwise(0.0)).alias("worst"))
    clear = rows.filter("matched >= 3").agg(F.avg((c("agree") >= GATE).cast("double")).alias("clear"))
    t = one.crossJoin(other).crossJoin(rho).crossJoin(worst).crossJoin(clear)  # one row each
    recall, spurious, most = c("m") / c("n"), c("nm") / c("nn"), c("most") / c("m")
    checks = [
        ("E1", c("flipped").between(0.35, 0.65), c("flipped")),
        ("E2", spurious < 0.25 * recall, spurious),
        ("E3", F.abs("rho") < 0.5, c("rho")),
        ("E4", c("worst") >= GATE, c("worst")),
        ("E5", c("clear") >= 0.6, c("clear")),
        ("E6", (recall > 0.05) & (recall < 0.95) & (most < 0.15), most),
    ]
    rows_of = F.array(*[F.struct(F.lit(k).alias("check"), F.when(fine, "PASS").otherwise("REVIEW").alias("verdict"), F.round(v, 6).alias("value")) for k, fine, v in checks])
    return t.select(F.explode(rows_of).alias("x")).select("x.*")


def agreement_quantiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Of runs with three matches or more: agreement at the given shares of the sorted runs (the value at floor(n * share))."""
    t = rows.filter("matched >= 3").select("agree")
    same = t.groupBy("agree").agg(F.count("*").alias("k"))
    n = t.agg(F.count("*").alias("n"))
    up = same.withColumn("up", F.sum("k").over(Window.orderBy("agree").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(n))  # distinct shares
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return up.agg(*[F.round(F.min(F.when(F.col("up") > at(p), F.col("agree"))), 6).alias(k) for k, p in shares.items()])


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """run, code_id, kind of two matchings (run, code_id, prose_id, verdict): identical, verdict_only, partner_only, partner_and_verdict, and
    what only one of them matched."""
    x, y = a.select("run", "code_id", F.struct("prose_id", "verdict").alias("x")), b.select("run", "code_id", F.struct("prose_id", "verdict").alias("y"))
    partner, verdict = F.col("x.prose_id").eqNullSafe(F.col("y.prose_id")), F.col("x.verdict").eqNullSafe(F.col("y.verdict"))
    kind = F.when(F.col("y").isNull(), "matched_only_in_A").when(F.col("x").isNull(), "matched_only_in_B").when(partner & verdict, "identical").when(partner, "verdict_only").when(verdict, "partner_only").otherwise("partner_and_verdict")
    return x.join(y, ["run", "code_id"], "full_outer").select("run", "code_id", kind.alias("kind"))


def stability(kinds: DataFrame) -> DataFrame:
    """One row: identical matches over those that both have, and over all that either has."""
    same, one = F.sum((F.col("kind") == "identical").cast("long")), F.sum(F.col("kind").startswith("matched_only").cast("long"))
    t = kinds.agg(F.count("*").alias("union"), same.alias("identical"), one.alias("one"))
    both = F.col("union") - F.col("one")
    return t.select("union", "identical", F.round(F.when(both > 0, F.col("identical") / both).otherwise(0.0), 6).alias("given_both"), F.round(F.when(F.col("union") > 0, F.col("identical") / F.col("union")).otherwise(0.0), 6).alias("over_union"))


def per_kind(rows: DataFrame, kind: str, n: int, key: str, order: Column | None = None) -> DataFrame:
    """Equally many rows of each kind, n altogether; where a kind has fewer, all of them."""
    kinds = rows.agg(F.countDistinct(kind).alias("_kinds"))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(uniform(key) if order is None else order, key))
    return rows.withColumn("_rank", rank).crossJoin(F.broadcast(kinds)).filter(F.col("_rank") <= F.floor(F.lit(n) / F.col("_kinds"))).drop("_rank", "_kinds")  # one row


def headers(tagged: DataFrame) -> DataFrame:
    """Per tag of choice (tag, corpus, run, did): its corpora, runs and decisions. Tags are few: a decision's are bits of one number, so each decision goes
    through the shuffle once, not once for each tag and distinct count."""
    faced = stored(tagged.select("tag", "corpus", "run").distinct())
    out = faced.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("corpus")), "+").alias("corpora"), F.countDistinct("run").alias("runs"))
    tags = [r["tag"] for r in faced.select("tag").distinct().collect()]
    words = range(0, len(tags), 63)
    bit = lambda at: F.coalesce(*[F.when(F.col("tag").eqNullSafe(F.lit(t)), F.lit(1 << i).cast("long")) for i, t in enumerate(tags[at : at + 63])], F.lit(0).cast("long"))
    per = tagged.dropna(subset=["did"]).groupBy("did").agg(*[F.bit_or(bit(at)).alias(f"w{at}") for at in words] or [F.lit(0).alias("w0")])
    counts = [F.struct(F.lit(t).cast(dict(tagged.dtypes)["tag"]).alias("tag"), F.coalesce(F.sum(F.getbit(f"w{i // 63 * 63}", F.lit(i % 63)).cast("long")), F.lit(0)).alias("decisions")) for i, t in enumerate(tags)]
    if not tags:
        return out.withColumn("decisions", F.lit(0).cast("long"))
    sizes = per.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select(F.col("x.tag").alias("_tag"), "x.decisions")  # one row of as many numbers as tags
    return out.join(F.broadcast(sizes), F.col("tag").eqNullSafe(F.col("_tag"))).drop("_tag")


def comparison_kind(a: Column, b: Column) -> Column:
    """What two headers (structs of corpora and decisions) allow to compare."""
    return F.when(a["corpora"] != b["corpora"], "scope_change").when(a["decisions"] != b["decisions"], "input_change").otherwise("replicate")
