"""Reading and checking a corpus of files: run discovery, lines, checksums, digests, caches, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def discover(spark: SparkSession, root: str, role: str, run: str, arm: str, least: int = 200) -> DataFrame:
    """run, arm, role, path, length: of each run's files of a role (regular expressions with one group over paths) the largest of `least`
    bytes or more; the next is the role's `_secondary`."""
    f = files(spark, root).select("path", "length")
    f = f.select("path", "length", F.regexp_extract("path", run, 1).alias("run"), F.regexp_extract("path", arm, 1).alias("arm"), F.regexp_extract("path", role, 1).alias("role")).filter((F.col("run") != "") & (F.col("role") != "") & (F.col("length") >= least))
    rank = F.row_number().over(Window.partitionBy("run", "role").orderBy(F.desc("length"), F.desc("path")))
    f = f.withColumn("_n", rank).filter("_n <= 2")
    return f.select("run", F.when(F.col("arm") == "", "unknown").otherwise(F.col("arm")).alias("arm"), F.when(F.col("_n") == 1, F.col("role")).otherwise(F.concat("role", F.lit("_secondary"))).alias("role"), "path", "length")


def lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, line, content; only line feeds break lines."""
    f = files(spark, root, glob).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")))
    return f.select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("content"))


def document(spark: SparkSession, root: str, tag: str, schema: str) -> DataFrame:
    """The JSON document of a tag. A missing one is an error; no other file stands in for it."""
    return spark.read.schema(schema).json(f"{root}/{tag}.json", multiLine=True)


def placeholders(spark: SparkSession, root: str, header: str = "version https://git-lfs") -> DataFrame:
    """Files that only point to their content: short, and starting with the header."""
    f = files(spark, root).filter("length < 200")
    return f.filter(F.decode("content", "UTF-8").startswith(header)).select("path", "length")


def checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return files(spark, root, glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, state: ok, changed, missing or untracked."""
    m, f = manifest.select("path", F.col("sha256").alias("want")), found.select("path", F.col("sha256").alias("have"))
    state = F.when(F.col("want").isNull(), "untracked").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "ok").otherwise("changed")
    return m.join(f, "path", "full_outer").select("path", state.alias("state"))


def layer_digest(found: DataFrame) -> DataFrame:
    """One row: the SHA-256 of all sorted path:digest lines of a layer (as hexadecimal text)."""
    return found.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256"))), "\n"), 256).alias("digest"))


def lock_state(locked: str | None, now: str | None) -> str:
    return "absent" if now is None else "unlocked" if locked is None else "locked" if locked == now else "STALE"


def sorted_json(fields: dict):
    """Columns by name as a JSON object whose keys are sorted, so that equal payloads read alike."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def cache_key(prompt_hash, model, payload: dict, schema: dict):
    """A request's address: the SHA-256 of its parts, payload and schema (columns by name) as JSON with sorted keys."""
    return F.sha2(F.concat_ws("\x1f", prompt_hash, model, sorted_json(payload), sorted_json(schema)), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key").distinct(), "key", "left_anti")


def unanswered(runs: DataFrame, answers: DataFrame, now: DataFrame) -> DataFrame:
    """Runs (run, prompt) without an answer (run, prompt, prompt_hash) at their prompt's current hash (prompt, prompt_hash)."""
    live = answers.join(now, ["prompt", "prompt_hash"], "left_semi").select("run", "prompt").distinct()
    return runs.join(live, ["run", "prompt"], "left_anti")


def resolve(spark: SparkSession, root: str, tag: str) -> str:
    """The path of a tag's garden, its own or that of the tag it descends from (dots part the steps); none of them there is an error."""
    steps = tag.split(".")
    for k in range(len(steps), 0, -1):
        path = f"{root}/tag={'.'.join(steps[:k])}"
        if not preflight(spark, [path]):
            return path
    raise LookupError(f"no garden for {tag}")


def write_distilled(root: str, coverage: DataFrame, silent: DataFrame, misalignments: DataFrame, by_arm: DataFrame) -> None:
    """The four tables of a distilled corpus, as tab-separated files."""
    for name, df in (("coverage", coverage), ("silent", silent), ("misalignments", misalignments), ("by_arm", by_arm)):
        write_tsv(df, f"{root}/{name}")


def promote(spark: SparkSession, root: str, tag: str, needed: list[str]) -> None:
    """Makes a tag the final one: all its analyses must be there, and the pointer is written last."""
    if missing := preflight(spark, [f"{root}/tag={tag}/{n}" for n in needed]):
        raise LookupError(f"{tag} lacks {missing}")
    spark.createDataFrame([(tag,)], "tag string").coalesce(1).write.mode("overwrite").parquet(f"{root}/final")


def final(spark: SparkSession, root: str) -> str:
    return spark.read.parquet(f"{root}/final").first()["tag"]


def change_lock(spark: SparkSession, log: str, layer: str, action: str, digest: str | None, decision: str) -> None:
    """Appends a lock or an unlock to the log; each says why."""
    if action not in ("lock", "unlock") or not decision.strip():
        raise ValueError("lock or unlock, with the decision behind it")
    n = spark.read.json(log, schema=LOCKS).count() if not preflight(spark, [log]) else 0
    append_log(spark.createDataFrame([(n, layer, action, digest if action == "lock" else None, decision)], LOCKS), log)


LOCKS = "n long, layer string, action string, digest string, decision string"


def lock_states(log: DataFrame, now: DataFrame) -> DataFrame:
    """layer, state by each layer's last entry in the log and its digest now (layer, digest): absent, unlocked, locked or STALE."""
    last = log.groupBy("layer").agg(F.max_by("action", "n").alias("action"), F.max_by("digest", "n").alias("want"))
    t = last.join(now, "layer", "full_outer")
    held = F.coalesce(F.col("action") == "lock", F.lit(False))
    return t.select("layer", F.when(F.col("digest").isNull(), "absent").when(~held, "unlocked").when(F.col("want") == F.col("digest"), "locked").otherwise("STALE").alias("state"))


def replicates(manifests: DataFrame, spend: DataFrame) -> DataFrame:
    """root, tag, cost: the newest final tag of each completed replicate's manifest (root, completed, at, tag), and what it cost (root, cost_usd)."""
    t = manifests.filter("completed").groupBy("root").agg(F.max_by("tag", "at").alias("tag"))
    return t.join(spend.groupBy("root").agg(F.round(F.sum("cost_usd"), 6).alias("cost")), "root", "left").fillna(0.0, ["cost"])


#: Item sources by name: functions from decisions, silent ones and misalignments to items. A study can register more.
KINDS: dict = {}


def item_source(name: str):
    def register(make):
        KINDS[name] = make
        return make

    return register


item_source("decision")(lambda decisions, silent, misaligned: decisions.select("run", "text"))
item_source("silent")(lambda decisions, silent, misaligned: silent.select("run", "text"))
item_source("misaligned")(lambda decisions, silent, misaligned: misaligned.select("run", F.col("note").alias("text")))


def study(spark: SparkSession, path: str) -> DataFrame:
    """corpus, root of a study's manifest, a JSON file with an object `corpora` of roots."""
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", "corpora map<string, string>").alias("s"))
    return t.select(F.explode("s.corpora").alias("corpus", "root"))


def checked(verdicts: DataFrame, *checks: tuple) -> DataFrame:
    """verdicts with complaint: the first of the checks (name, condition that must hold) that a row fails; null for a sound row."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(checks):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return verdicts.withColumn("complaint", out)


def prune_classes(cache: DataFrame, shipped: DataFrame) -> DataFrame:
    """key, class: reachable, edited (the prompt has another hash now), not shipped (no such prompt) or unreadable."""
    s = shipped.select("prompt", F.col("prompt_hash").alias("now"))
    state = F.when(F.col("result").isNull(), "unreadable").when(F.col("now").isNull(), "not shipped").when(F.col("now") != F.col("prompt_hash"), "edited").otherwise("reachable")
    return cache.join(s, "prompt", "left").select("key", state.alias("class"))


def spend(cache: DataFrame) -> DataFrame:
    return cache.groupBy("prompt", "model").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))


def outcome_states(stored: DataFrame, backing: DataFrame, fields: list[str]) -> DataFrame:
    """run, state: verified, orphan (only stored), unbacked (only backing), or mismatch, by null-safe comparison of fields."""
    a, b = stored.select("run", F.struct(*fields).alias("x")), backing.select("run", F.struct(*fields).alias("y"))
    return a.join(b, "run", "full_outer").select("run", F.when(F.col("y").isNull(), "orphan").when(F.col("x").isNull(), "unbacked").when(F.col("x").eqNullSafe(F.col("y")), "verified").otherwise("mismatch").alias("state"))


def stale_headers(stored: DataFrame, choice: DataFrame) -> DataFrame:
    """Headers (tag, n_decisions, n_options, n_forks) that don't equal what choice (tag, did, fork, option) gives."""
    real = choice.groupBy("tag").agg(F.count("*").alias("d"), F.countDistinct("fork", "option").alias("o"), F.countDistinct("fork").alias("f"))
    return stored.join(real, "tag", "left").filter(~(F.col("n_decisions").eqNullSafe(F.col("d")) & F.col("n_options").eqNullSafe(F.col("o")) & F.col("n_forks").eqNullSafe(F.col("f"))))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tagged(df: DataFrame, path: str, tag: str) -> None:
    """One analysis of one tag, replacing only that tag's part."""
    df.withColumn("tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def preflight(spark: SparkSession, paths: list[str]) -> list[str]:
    """All of the paths that aren't there, before anything runs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(conf).exists(at):
            out.append(p)
    return out
