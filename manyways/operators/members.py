"""From options with lists of members to one row a decision, and tables that verdicts and builds relabel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 55
ROUND = 70


def exploded(options: DataFrame, decisions: DataFrame) -> DataFrame:
    """options (oid, fork, option, members) x their members, joined with decisions (did, ...). Members that are no decision drop out."""
    m = options.select("oid", "fork", "option", F.explode("members").alias("did"))
    return m.join(decisions, "did")


def instance_key(choice: DataFrame) -> DataFrame:
    """choice with the key by which two builds know the same decision: its run, line and the first 60 characters of its text."""
    return choice.withColumn("key", F.struct("run", "line", F.substring("text", 1, 60).alias("prefix")))


def builds(a: DataFrame, b: DataFrame, label: str = "fork") -> DataFrame:
    """run, line, a, b: the labels that two builds give to the instances both have; of repeated instances, the first label by did."""
    first = lambda d, n: instance_key(d).groupBy("key").agg(F.min_by(label, "did").alias(n))
    return first(a, "a").join(first(b, "b"), "key").select(F.col("key.run").alias("run"), F.col("key.line").alias("line"), "a", "b")


def relabelled(choice: DataFrame, heads: DataFrame, induced: bool) -> DataFrame:
    """choice with forks renamed by sibling verdicts (fork, head); a vocabulary whose forks were induced already stays as it is."""
    if induced:
        return choice
    return choice.join(heads, "fork", "left").withColumn("fork", F.coalesce("head", "fork")).drop("head")


def backfilled(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Verdicts (label, id) for items (id, text): ids that are no items drop out, items that no verdict names become groups of their own."""
    known = groups.join(items.select("id"), "id", "left_semi").select("label", "id", F.lit(False).alias("backfill"))
    rest = items.join(groups.select("id").distinct(), "id", "left_anti").select(F.substring("text", 1, 90).alias("label"), "id", F.lit(True).alias("backfill"))
    return known.union(rest)


def induced(choice: DataFrame, points: DataFrame) -> DataFrame:
    """choice with each option moved to the decision point (point, option) that names it first; the old fork is kept."""
    first = points.groupBy("option").agg(F.min("point").alias("point"))
    return choice.join(first, "option", "left").withColumn("fork_raw", F.col("fork")).withColumn("fork", F.coalesce("point", "fork")).drop("point")


def co_pairs(choice: DataFrame, points: DataFrame, least: int = 2, warn: float = 0.25) -> DataFrame:
    """Per decision point of two options or more: the share of its option pairs that `least` runs or more hold both of, and whether that
    is too many for alternatives."""
    n = points.groupBy("point").agg(F.countDistinct("option").alias("options")).filter("options > 1")
    d = points.select("point", "option").distinct().join(choice.select("run", "option").distinct(), "option")
    both = d.select("point", "run", F.col("option").alias("a")).join(d.select("point", "run", F.col("option").alias("b")), ["point", "run"]).filter("a < b")
    hit = both.groupBy("point", "a", "b").agg(F.count("*").alias("k")).filter(F.col("k") >= least).groupBy("point").agg(F.count("*").alias("hits"))
    share = F.coalesce("hits", F.lit(0)) / (F.col("options") * (F.col("options") - 1) / 2)
    return n.join(hit, "point", "left").select("point", "options", F.round(share, 6).alias("share"), (share > warn).alias("flagged"))


def unioned(parts: list[DataFrame], key: str) -> DataFrame:
    """Items of several corpora one behind the other, numbered through: id is an item's rank in its corpus plus the sizes of those before.
    Ranks are per corpus, so no corpus waits for another."""
    tagged = None
    for i, p in enumerate(parts):
        q = p.select(F.lit(i).alias("corpus"), "*")
        tagged = q if tagged is None else tagged.unionByName(q)
    sizes = tagged.groupBy("corpus").agg(F.count("*").alias("n"))
    offset = sizes.select("corpus", F.coalesce(F.sum("n").over(Window.orderBy("corpus").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # a row for each corpus
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(key)) - 1
    return tagged.withColumn("rank", rank).join(F.broadcast(offset), "corpus").withColumn("id", F.col("offset") + F.col("rank")).drop("rank", "offset")


def shared_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("run").intersect(b.select("run"))


def batches(targets: DataFrame, size: int = BATCH) -> DataFrame:
    """id, target, batch: items (id, line, target; one row for each target, in normal form) in the order of their rarest target, then line
    and id, cut into batches of `size`."""
    freq = targets.groupBy("target").agg(F.count("*").alias("freq"))
    rare = targets.join(freq, "target").groupBy("id", "line").agg(F.min(F.struct("freq", "target"))["target"].alias("target"))
    # ranks within a target, and the sizes of the targets before it, instead of one order of all items
    own = F.row_number().over(Window.partitionBy("target").orderBy("line", "id")) - 1
    n = rare.groupBy("target").agg(F.count("*").alias("n"))
    before = n.select("target", F.coalesce(F.sum("n").over(Window.orderBy("target").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rare.withColumn("own", own).join(before, "target").select("id", "target", F.floor((F.col("before") + F.col("own")) / size).cast("long").alias("batch"))


def merge_order(groups: DataFrame, step: int = ROUND) -> DataFrame:
    """groups (i, ...) with the place in a merge round in which neighbours lie far apart: by i modulo step, then i."""
    n = groups.agg(F.count("*").alias("n"))
    full, rest = F.floor(F.col("n") / step), F.col("n") % step
    r = F.col("i") % step
    place = r * full + F.least(r, rest) + F.floor(F.col("i") / step)  # i runs from 0 without gaps
    return groups.crossJoin(F.broadcast(n)).withColumn("place", place.cast("long")).drop("n")  # one row


def interleaved(questions: DataFrame, order: list[str]) -> DataFrame:
    """questions (check, rank, ...) in rounds: one of each check in turn, in the given order of checks."""
    turn = F.array_position(F.array(*map(F.lit, order)), F.col("check"))
    w = Window.partitionBy("check").orderBy("rank")
    return questions.filter(turn > 0).withColumn("round", F.row_number().over(w)).withColumn("turn", turn)


def first_writer(tags: DataFrame) -> DataFrame:
    """tag, family of tags (batch, tag, family): the first batch that names a tag decides."""
    return tags.groupBy("tag").agg(F.min(F.struct("batch", "family"))["family"].alias("family"))


def families(used: DataFrame, tags: DataFrame) -> DataFrame:
    """used (fork, tag) with families; a tag without one is its own, and a fork's repeated families count once."""
    return used.join(first_writer(tags), "tag", "left").select("fork", F.coalesce("family", "tag").alias("family")).distinct()


def recovered_arms(records: DataFrame, found: DataFrame) -> DataFrame:
    """records (run, arm) with missing arms from the corpus's layout (found: run, arm), `unknown` where that has none either."""
    return records.join(found.groupBy("run").agg(F.min("arm").alias("_found")), "run", "left").withColumn("arm", F.coalesce("arm", "_found", F.lit("unknown"))).drop("_found")


def provenance(choice: DataFrame, tags: DataFrame) -> DataFrame:
    """choice with its run's provenance; corpus where none is recorded."""
    return choice.join(tags.groupBy("run").agg(F.min("provenance").alias("provenance")), "run", "left").withColumn("provenance", F.coalesce("provenance", F.lit("corpus")))


def assigned(items: DataFrame, verdicts: DataFrame, least: int = 3) -> DataFrame:
    """items (id) with a category by verdicts (id, category): NEW without one; categories of fewer than `least` items are consolidated."""
    t = items.join(verdicts.groupBy("id").agg(F.min("category").alias("category")), "id", "left").withColumn("category", F.coalesce("category", F.lit("NEW")))
    n = F.count("*").over(Window.partitionBy("category"))
    return t.withColumn("category", F.when((n >= least) | (F.col("category") == "NEW"), F.col("category")).otherwise("other"))


def traced(choice: DataFrame, needle: str) -> DataFrame:
    """The decisions of forks whose handle or name the needle finds."""
    handle = F.concat(F.lit("fork:"), F.substring(F.sha1(F.col("fork").cast("binary")), 1, 8))
    return choice.filter((handle == needle) | F.lower("fork").contains(needle.lower())).select(handle.alias("handle"), "fork", "option", "run", "line", "did")


def chain(tag: str) -> tuple[list[str], str]:
    """The stages of a lineage tag, in order, and what to call it: dots part the repairs that a vocabulary went through."""
    base, *steps = tag.split(".")
    return [base, *steps], base if not steps else f"{base} ({', '.join(steps)})"


def final_tag(tags: list[str], named: str | None, headline: str) -> tuple[str, str]:
    """The tag to render, and a warning if that isn't the headline one; a named one must be there."""
    chosen = named or headline
    if chosen not in tags:
        raise LookupError(f"no vocabulary {chosen}")
    return chosen, "" if chosen == headline else f"{chosen} is not the final vocabulary {headline}"
