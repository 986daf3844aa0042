"""How contested each fork is, how widely it is reached, and what its options look like. All counts are of runs unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyways.operators.cluster import stored

LEAST_RUNS = 10
PIVOTAL = 1.5
SETTLED = 0.8
CONTESTED = 3.0


def modal(choice: DataFrame) -> DataFrame:
    """fork, run, option: each run's one vote at a fork, its most frequent option; ties go to the one that the run shows first."""
    per = choice.groupBy("fork", "run", "option").agg(F.count("*").alias("n"), F.min(F.struct("line", "did")).alias("seen"))
    return per.groupBy("fork", "run").agg(F.min(F.struct((-F.col("n")).alias("m"), "seen", "option"))["option"].alias("option"))


def votes(choice: DataFrame) -> DataFrame:
    return modal(choice).groupBy("fork", "option").agg(F.count("*").alias("c"))


def run_count(choice: DataFrame) -> DataFrame:
    return choice.agg(F.countDistinct("run").alias("n_runs"))


def fork_stats(choice: DataFrame) -> DataFrame:
    """Per fork: reach, coverage, absent runs, effective options among those who reached it and with absence as one more level, number of
    modal options, modal share."""
    m = modal(choice)  # read twice; its shuffle is done once
    return stats_of(m.groupBy("fork", "option").agg(F.count("*").alias("c")), run_count(m))


def stats_of(votes: DataFrame, runs: DataFrame) -> DataFrame:
    """fork_stats() from counts of votes (fork, option, c) and the number of runs (one row)."""
    per = votes.groupBy("fork").agg(F.sum("c").alias("reach"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.count("*").alias("options"), F.max("c").alias("top"))
    n = F.col("n_runs")
    return per.crossJoin(F.broadcast(runs)).select(  # one row
        "fork", "reach", (n - F.col("reach")).alias("absent"), F.round(F.col("reach") / n, 6).alias("coverage"),
        F.round(F.col("reach") * F.col("reach") / F.col("sq"), 6).alias("eff_reached"),
        F.round(n * n / (F.col("sq") + (n - F.col("reach")) * (n - F.col("reach"))), 6).alias("eff_all"), "options", F.round(F.col("top") / F.col("reach"), 6).alias("modal_share"),
    )


def pivotal(choice: DataFrame) -> DataFrame:
    """Measurable forks (LEAST_RUNS runs or more) with more than PIVOTAL effective options, absence counted."""
    return fork_stats(choice).filter((F.col("reach") >= LEAST_RUNS) & (F.col("eff_all") > PIVOTAL))


def qualifying(choice: DataFrame) -> DataFrame:
    return fork_stats(choice).filter((F.col("coverage") >= 0.25) & (F.col("eff_reached") > PIVOTAL)).select("fork", "coverage", "eff_reached")


def option_runs(choice: DataFrame) -> DataFrame:
    """fork, option, c: how many runs ever took the option (a run may count for two)."""
    return choice.groupBy("fork", "option").agg(F.countDistinct("run").alias("c"))


def reach(choice: DataFrame) -> DataFrame:
    return choice.groupBy("fork").agg(F.countDistinct("run").alias("runs"))


def stability(choice: DataFrame) -> DataFrame:
    """Per measurable fork over run sets: modal share, concentration, stable options (a tenth of the runs, at least 3), novel ones (1 run)."""
    joined = option_runs(choice).join(reach(choice).filter(F.col("runs") >= LEAST_RUNS), "fork")
    total = F.sum("c")
    return joined.groupBy("fork").agg(
        F.max("runs").alias("runs"), F.count("*").alias("options"), F.round(F.max("c") / F.max("runs"), 6).alias("modal_share"),
        F.round(F.sum(F.col("c") * F.col("c")) / (total * total), 6).alias("hhi"), F.sum((F.col("c") >= F.greatest(F.lit(3.0), 0.10 * F.col("runs"))).cast("long")).alias("stable_options"),
        F.sum((F.col("c") == 1).cast("long")).alias("novel_options"), F.round(F.avg((F.col("c") == 1).cast("double")), 6).alias("novel_share"),
        F.array_join(F.transform(F.sort_array(F.collect_list("c"), asc=False), lambda x: x.cast("string")), ",").alias("counts"),
    )


def spectrum(choice: DataFrame) -> DataFrame:
    """How many options exactly k runs chose."""
    return option_runs(choice).groupBy(F.col("c").alias("k")).agg(F.count("*").alias("options"))


def provenance_delta(choice: DataFrame, *others: str) -> DataFrame:
    """Measurable forks' mean modal share and mean effective options, over all runs and without those of some arms."""
    whole, less = (fork_stats(c).filter(F.col("reach") >= LEAST_RUNS).agg(F.count("*").alias("forks"), F.round(F.avg("modal_share"), 6).alias("modal_share"), F.round(F.avg("eff_reached"), 6).alias("eff_reached")) for c in (choice, choice.filter(~F.col("arm").isin(*others))))
    return whole.withColumn("which", F.lit("all")).unionByName(less.withColumn("which", F.lit("without")))


def arm_richness(choice: DataFrame) -> DataFrame:
    """Per arm: options touched, options of one run, options that no other arm has, and options per run."""
    per = choice.groupBy("fork", "option", "arm").agg(F.countDistinct("run").alias("c"))
    every = per.groupBy("fork", "option").agg(F.count("*").alias("arms"), F.sum("c").alias("total"))
    runs = choice.groupBy("arm").agg(F.countDistinct("run").alias("runs"))
    out = per.join(every, ["fork", "option"]).groupBy("arm").agg(F.count("*").alias("options"), F.sum((F.col("total") == 1).cast("long")).alias("singletons"), F.sum((F.col("arms") == 1).cast("long")).alias("private"))
    return out.join(runs, "arm").withColumn("per_run", F.round(F.col("options") / F.col("runs"), 6))


def comparison(choice: DataFrame) -> DataFrame:
    """One row on a whole vocabulary: forks, options, measurable forks, medians, single-run options, conventions, contested, universal."""
    s = fork_stats(choice)
    measured = F.col("reach") >= LEAST_RUNS
    row = s.agg(
        F.count("*").alias("forks"), F.sum("options").alias("options"), F.sum(measured.cast("long")).alias("measurable"),
        F.round(F.median(F.when(measured, F.col("options"))), 6).alias("median_options"), F.round(F.median(F.when(measured, F.col("modal_share"))), 6).alias("median_modal"), F.round(F.median(F.when(measured, F.col("eff_reached"))), 6).alias("median_eff"),
        F.sum((measured & (F.col("modal_share") >= SETTLED)).cast("long")).alias("conventions"), F.sum((measured & (F.col("eff_reached") >= CONTESTED)).cast("long")).alias("contested"),
        F.sum((F.col("coverage") >= 0.6).cast("long")).alias("universal"),
    )
    return row.crossJoin(F.broadcast(option_runs(choice).agg(F.sum((F.col("c") == 1).cast("long")).alias("singles"))))  # one row each


def flipped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Forks measurable in both whose modal share crosses SETTLED."""
    a, b = (fork_stats(c).filter(F.col("reach") >= LEAST_RUNS).select("fork", F.col("modal_share").alias(n)) for c, n in ((before, "before"), (after, "after")))
    return a.join(b, "fork").filter((F.col("before") >= SETTLED) != (F.col("after") >= SETTLED))


def positions(choice: DataFrame) -> DataFrame:
    """fork, runs, options, position: the upper median of each decision's relative place in its run."""
    length = Window.partitionBy("run")
    p = choice.withColumn("p", F.col("line") / F.max("line").over(length))
    per = p.groupBy("fork").agg(F.countDistinct("run").alias("runs"), F.countDistinct("option").alias("options"), F.count("*").alias("n"))
    same = p.groupBy("fork", "p").agg(F.count("*").alias("k"))  # equal places add up before they are ordered
    up_to = F.sum("k").over(Window.partitionBy("fork").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    middle = same.withColumn("up_to", up_to).join(per.select("fork", "n"), "fork").filter(F.col("up_to") > F.floor(F.col("n") / 2)).groupBy("fork").agg(F.min("p").alias("p"))
    return per.join(middle, "fork").select("fork", "runs", "options", F.round("p", 6).alias("position"))


def node_classes(choice: DataFrame) -> DataFrame:
    c = F.col("coverage")
    kind = F.when(c >= 0.6, "universal").when(c >= 0.25, "common").when(c >= 0.05, "occasional").otherwise("rare")
    return fork_stats(choice).groupBy(kind.alias("class")).agg(F.count("*").alias("forks"))


def path_space(choice: DataFrame, least: float = 0.6) -> DataFrame:
    """Over universal forks: runs with a full row, distinct full paths, the log of the number of possible ones, and observed option pairs."""
    m = stored(modal(choice))
    universal = stats_of(m.groupBy("fork", "option").agg(F.count("*").alias("c")), run_count(m)).filter(F.col("coverage") >= least).select("fork", "options")
    m = m.join(universal, "fork")
    k = universal.agg(F.count("*").alias("k"), F.round(F.sum(F.ln("options")), 6).alias("log_paths"))
    rows = m.groupBy("run").agg(F.count("*").alias("forks"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "fork", "option")))), 256).alias("path"))
    full = rows.crossJoin(F.broadcast(k)).filter(F.col("forks") == F.col("k"))  # one row
    paths = full.agg(F.count("*").alias("complete_runs"), F.countDistinct("path").alias("distinct_paths"))
    a, b = m.select("run", F.col("fork").alias("fa"), F.col("option").alias("oa")), m.select("run", F.col("fork").alias("fb"), F.col("option").alias("ob"))
    pairs = a.join(b, "run").filter("fa < fb").select("fa", "oa", "fb", "ob").distinct().agg(F.count("*").alias("pairs_seen"))
    o = universal.agg(((F.sum("options") * F.sum("options") - F.sum(F.col("options") * F.col("options"))) / 2).alias("possible"))
    t = paths.crossJoin(k).crossJoin(pairs).crossJoin(o)  # one row each
    return t.select("complete_runs", "distinct_paths", F.col("k").alias("universal_forks"), "log_paths", "pairs_seen", F.round(F.when(F.col("possible") > 0, F.col("pairs_seen") / F.col("possible")), 6).alias("pair_share"))


def run_novelty(choice: DataFrame) -> DataFrame:
    """Per run: options that only it chose, at measurable forks, per decision."""
    novel = option_runs(choice).filter("c = 1").join(reach(choice).filter(F.col("runs") >= LEAST_RUNS).select("fork"), "fork").select("fork", "option")
    held = choice.select("run", "fork", "option").distinct().join(novel, ["fork", "option"]).groupBy("run").agg(F.count("*").alias("novel"))
    per = choice.groupBy("run").agg(F.count("*").alias("decisions"), F.first("arm").alias("arm"))
    return per.join(held, "run", "left").select("run", "arm", "decisions", F.coalesce("novel", F.lit(0)).alias("novel"), F.round(F.coalesce("novel", F.lit(0)) / F.col("decisions"), 6).alias("score"))


def arm_novelty(choice: DataFrame) -> DataFrame:
    return run_novelty(choice).groupBy("arm").agg(F.count("*").alias("runs"), F.sum("novel").alias("novel"), F.round(F.sum("novel") / F.sum("decisions"), 6).alias("rate"))


def fork_novelty(choice: DataFrame) -> DataFrame:
    joined = option_runs(choice).join(reach(choice).filter(F.col("runs") >= LEAST_RUNS), "fork")
    return joined.groupBy("fork").agg(F.sum((F.col("c") == 1).cast("long")).alias("novel"), F.count("*").alias("options")).withColumn("share", F.round(F.col("novel") / F.col("options"), 6))


def vocabulary_report(choice: DataFrame) -> DataFrame:
    """Per fork by decisions: how many, the runs, the top option's share, the rate of single-decision options."""
    per = choice.groupBy("fork", "option").agg(F.count("*").alias("n"))
    out = per.groupBy("fork").agg(F.sum("n").alias("decisions"), F.round(F.max("n") / F.sum("n"), 6).alias("top_share"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("singleton_rate"))
    return out.join(reach(choice), "fork")


def atlas(choice: DataFrame) -> DataFrame:
    """Per measurable fork: statistics, options of one run, position and quadrant: live (faced by half of the runs, settled by none),
    convention (faced by half, settled), idiosyncratic (faced by fewer, settled by none), rare and settled."""
    s = fork_stats(choice).filter(F.col("reach") >= LEAST_RUNS).join(positions(choice).select("fork", "position"), "fork")
    single = option_runs(choice).groupBy("fork").agg(F.sum((F.col("c") == 1).cast("long")).alias("singletons"))
    wide, split = F.col("coverage") >= 0.5, F.col("eff_reached") >= CONTESTED
    quadrant = F.when(wide & split, "live").when(wide, "convention").when(split, "idiosyncratic").otherwise("rare and settled")
    return s.join(single, "fork").select("fork", "coverage", "eff_reached", "modal_share", "singletons", "position", quadrant.alias("quadrant"))


def stage_medians(choice: DataFrame, stages: DataFrame) -> DataFrame:
    """Per stage (stages: fork, stage; modeling where none is known): measurable forks, the upper median and the largest of their
    effective options."""
    s = with_stage(fork_stats(choice).filter(F.col("reach") >= LEAST_RUNS), stages)
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("eff_reached", "fork")) - 1
    n = F.count("*").over(Window.partitionBy("stage"))
    t = s.select("stage", "eff_reached", (rank == F.floor(n / 2)).alias("middle"))
    return t.groupBy("stage").agg(F.count("*").alias("forks"), F.max(F.when(F.col("middle"), F.col("eff_reached"))).alias("median"), F.max("eff_reached").alias("largest"))


def with_stage(forks: DataFrame, stages: DataFrame) -> DataFrame:
    """forks with the stage that a verdict gives them, modeling without one."""
    return forks.join(stages.groupBy("fork").agg(F.min("stage").alias("stage")), "fork", "left").withColumn("stage", F.coalesce("stage", F.lit("modeling")))


def merged_positions(choice: DataFrame, heads: DataFrame) -> DataFrame:
    """Of forks that verdicts (fork, head) make one: the mean of the members' positions, weighted by their runs."""
    p = positions(choice).join(heads, "fork")
    return p.groupBy("head").agg(F.count("*").alias("forks"), F.round(F.sum(F.col("position") * F.col("runs")) / F.sum("runs"), 6).alias("position"))


def fork_sizes(choice: DataFrame, silent: DataFrame) -> DataFrame:
    """Per fork: options, decisions, and how many of these (silent: did) no prose mentions."""
    c = choice.join(silent.select("did", F.lit(1).alias("quiet")).distinct(), "did", "left")
    return c.groupBy("fork").agg(F.countDistinct("option").alias("options"), F.count("*").alias("decisions"), F.count("quiet").alias("silent"))


def typology(items: DataFrame, category: str, arm: str, arms: list[str]) -> DataFrame:
    """Categories by arms: how many items."""
    out = items.groupBy(category).pivot(arm, arms).count()
    return out.select(category, *[F.coalesce(F.col(f"`{a}`"), F.lit(0)).alias(a) for a in arms])


def notable(choice: DataFrame, k: int = 6) -> DataFrame:
    s = fork_stats(choice).withColumn("weight", F.round(F.col("eff_reached") * F.col("coverage"), 6))
    return s.orderBy(F.desc("weight"), "fork").limit(k).select("fork", "weight")


def contested(choice: DataFrame, k: int = 12, settled: bool = False) -> DataFrame:
    """The measurable forks of least (or, settled, greatest) modal share."""
    s = fork_stats(choice).filter(F.col("reach") >= LEAST_RUNS).select("fork", "modal_share", "reach")
    return s.orderBy(F.desc("modal_share") if settled else F.asc("modal_share"), "fork").limit(k)


def top_options(choice: DataFrame, k: int = 14) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("fork").orderBy(F.desc("c"), "option"))
    return option_runs(choice).withColumn("rank", rank).filter(F.col("rank") <= k)


def option_arms(choice: DataFrame) -> DataFrame:
    """Each option's histogram over arms, as text."""
    per = choice.groupBy("fork", "option", "arm").agg(F.countDistinct("run").alias("c"))
    entry = F.concat_ws(":", "arm", F.col("c").cast("string"))
    return per.groupBy("fork", "option").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("arms"), F.sum("c").alias("n"))
