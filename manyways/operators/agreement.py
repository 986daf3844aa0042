"""How far two clusterings (columns a and b of the same items) agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyways.functions.stats import ln_factorial
from manyways.operators.cluster import cut, one_to_one, stored


def contingency(items: DataFrame, *over: str, weight: str | None = None) -> DataFrame:
    """Cells with margins: n of (a, b), na of a, nb of b and the total, within each group of `over`."""
    cell = items.groupBy(*over, "a", "b").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    w = lambda *c: Window.partitionBy(*over, *c)
    return cell.select("*", F.sum("n").over(w("a")).alias("na"), F.sum("n").over(w("b")).alias("nb"), F.sum("n").over(w()).alias("total"))


def _comb2(x):
    return x * (x - 1) / 2


def _margins(items: DataFrame, over: tuple[str, ...], weight: str | None):
    cell = items.groupBy(*over, "a", "b").agg((F.sum(weight) if weight else F.count("*")).cast("double").alias("n"))
    one = F.lit(1).alias("_one")
    keys = [*over, "_one"] if over else ["_one"]
    side = lambda c: cell.groupBy(*over, c).agg(F.sum("n").alias("m")).groupBy(*over, one).agg(F.sum(_comb2(F.col("m"))).alias(f"s{c}"), F.sum("m").alias(f"t{c}"))
    both = cell.groupBy(*over, one).agg(F.sum(_comb2(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    return both.join(side("a"), keys).join(side("b"), keys)


def adjusted_rand(items: DataFrame, *over: str, weight: str | None = None) -> DataFrame:
    """items, ari: 1 if the best possible equals the expected; null for fewer than two items."""
    m = _margins(items, over, weight)
    expected = F.col("sa") * F.col("sb") / _comb2(F.col("total"))
    best = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.col("total") < 2, F.lit(None)).when(best == expected, 1.0).otherwise((F.col("s") - expected) / (best - expected))
    return m.select(*over, F.col("total").cast("long").alias("items"), F.round(ari, 6).alias("ari"))


def pair_recall(items: DataFrame, *over: str) -> DataFrame:
    """The share of a's pairs that b keeps, and of b's that a has."""
    m = _margins(items, over, None)
    return m.select(*over, F.round(F.col("s") / F.col("sa"), 6).alias("a_in_b"), F.round(F.col("s") / F.col("sb"), 6).alias("b_in_a"))


def variation_of_information(items: DataFrame) -> DataFrame:
    c = contingency(items)
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    return c.agg(F.sum(-p * (F.log2(p / pa) + F.log2(p / pb))).alias("v"), F.max("total").alias("t")).select(F.round("v", 6).alias("bits"), F.round(F.col("v") / F.log2("t"), 6).alias("normalised"))


def b_cubed(items: DataFrame) -> DataFrame:
    """a is the truth: precision looks within b's clusters, recall within a's."""
    c = contingency(items).agg(F.sum(F.col("n") * F.col("n") / F.col("nb")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("na")).alias("r"), F.max("total").alias("t"))
    p, r = F.col("p") / F.col("t"), F.col("r") / F.col("t")
    return c.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def events(items: DataFrame) -> DataFrame:
    """Clusters of a that b splits or leaves whole, and clusters of b that merge several of a."""
    d = items.select("a", "b").distinct()
    a, b = d.groupBy("a").agg(F.count("*").alias("k")), d.groupBy("b").agg(F.count("*").alias("m"))
    stable = d.join(a.filter("k = 1"), "a").join(b.filter("m = 1"), "b").agg(F.count("*").alias("stable"))
    return a.agg(F.sum((F.col("k") > 1).cast("long")).alias("split")).crossJoin(b.agg(F.sum((F.col("m") > 1).cast("long")).alias("merged"))).crossJoin(stable)  # one row each


def direction(items: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Whether b is finer or coarser than a, by B-cubed and by numbers of clusters."""
    n = items.agg(F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"))
    d = F.col("precision") - F.col("recall")
    return b_cubed(items).crossJoin(n).select("precision", "recall", "ka", "kb", F.when(d > tolerance, "finer").when(d < -tolerance, "coarser").otherwise("even").alias("by_items"), F.when(F.col("kb") > F.col("ka"), "finer").when(F.col("kb") < F.col("ka"), "coarser").otherwise("even").alias("by_clusters"))


def dispersion(items: DataFrame, share: float = 0.9) -> DataFrame:
    """Per cluster of a: how many clusters of b hold `share` of it, largest first: intact (1), split (2 or 3) or scattered."""
    cell = items.groupBy("a", "b").agg(F.count("*").alias("n"))
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    run = cell.select("a", "n", F.row_number().over(w).alias("rank"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.sum("n").over(Window.partitionBy("a")).alias("size"))
    need = run.filter(F.col("sum") >= share * F.col("size")).groupBy("a").agg(F.min("rank").cast("long").alias("clusters"), F.max("size").alias("size"))
    return need.withColumn("kind", F.when(F.col("clusters") == 1, "intact").when(F.col("clusters") <= 3, "split").otherwise("scattered"))


def meet(items: DataFrame, *labels: str) -> DataFrame:
    """The common refinement of several clusterings."""
    return items.groupBy(*labels).agg(F.count("*").alias("n"))


#: Chances below exp(-TAIL), about 1e-43, don't change a sum of doubles.
TAIL = 100.0


def adjusted_mutual_information(items: DataFrame, *over: str) -> DataFrame:
    """n, mi, ami: mutual information of a and b (natural logarithm) and what is left of it beyond chance, over the mean entropy beyond
    chance; 1 where both are one cluster, or all single. Expected values sum the hypergeometric terms of each pair of clusters, as far from
    the mean as terms can change a double: by Bernstein's bound all others together have a chance below exp(-TAIL)."""
    cell = stored(items.groupBy(*over, "a", "b").agg(F.count("*").cast("double").alias("n")))
    side = lambda c: cell.groupBy(*over, c).agg(F.sum("n").alias(f"n{c}"))
    one = F.lit(1).alias("_one")
    keys = [*over, "_one"]
    total = cell.groupBy(*over, one).agg(F.sum("n").alias("t"))
    a, b = side("a"), side("b")
    p = lambda x: x / F.col("t")
    entropy = lambda s, c: s.withColumn("_one", F.lit(1)).join(total, keys).groupBy(*keys).agg((-F.sum(p(F.col(f"n{c}")) * F.ln(p(F.col(f"n{c}"))))).alias(f"h{c}"), F.count("*").alias(f"k{c}"))
    mi = cell.join(a, [*over, "a"]).join(b, [*over, "b"]).withColumn("_one", F.lit(1)).join(total, keys).groupBy(*keys).agg(F.sum(p(F.col("n")) * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    # clusters of one size have one term, so pairs of sizes are enough
    sizes = lambda s, c: s.groupBy(*over, f"n{c}").agg(F.count("*").alias(f"m{c}")).withColumn("_one", F.lit(1))
    pairs = sizes(a, "a").join(sizes(b, "b"), keys).join(total, keys)
    na, nb, t = F.col("na"), F.col("nb"), F.col("t")
    mean = na * nb / t
    room = TAIL / 3 + F.sqrt(F.lit(TAIL * TAIL / 9) + 2 * TAIL * mean * (1 - nb / t))  # 2 exp(-r * r / (2 * variance + 2 * r / 3)) beyond r, the variance at most mean * (1 - nb / t)
    low, high = F.greatest(F.lit(1.0), na + nb - t, F.floor(mean - room)), F.least(na, nb, F.ceil(mean + room))
    fixed = ln_factorial(na) + ln_factorial(nb) + ln_factorial(t - na) + ln_factorial(t - nb) - ln_factorial(t)
    term = lambda k: k / t * F.ln(t * k / (na * nb)) * F.exp(F.col("fixed") - ln_factorial(k) - ln_factorial(na - k) - ln_factorial(nb - k) - ln_factorial(t - na - nb + k))
    each = pairs.withColumn("fixed", fixed).withColumn("k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    emi = each.groupBy(*keys).agg(F.sum(F.col("ma") * F.col("mb") * term(F.col("k").cast("double"))).alias("emi"))
    out = mi.join(emi, keys).join(entropy(a, "a"), keys).join(entropy(b, "b"), keys).join(total, keys)
    trivial = ((F.col("ka") == 1) & (F.col("kb") == 1)) | ((F.col("ka") == F.col("t")) & (F.col("kb") == F.col("t")))
    spread = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    ami = F.when(trivial, 1.0).when(F.abs(spread) < 1e-12, 0.0).otherwise((F.col("mi") - F.col("emi")) / spread)
    return out.select(*over, F.col("t").cast("long").alias("n"), F.round("mi", 6).alias("mi"), F.round(ami, 6).alias("ami"))


def comparable(slots: DataFrame, forks: DataFrame, least: int = 30) -> DataFrame:
    """slot, fork, run, a, b: the choices (slot, run, choice) and (fork, run, choice) of pairs that `least` runs or more share, both
    sides of which vary over those runs."""
    t = slots.select("slot", "run", F.col("choice").alias("a")).join(forks.select("fork", "run", F.col("choice").alias("b")), "run")
    fine = t.groupBy("slot", "fork").agg(F.count("*").alias("n"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb")).filter((F.col("n") >= least) & (F.col("ka") >= 2) & (F.col("kb") >= 2))
    return t.join(fine.select("slot", "fork"), ["slot", "fork"])


def best_slots(slots: DataFrame, forks: DataFrame, least: int = 30) -> DataFrame:
    """Per slot the fork whose options agree best with its choices, beyond chance."""
    ami = adjusted_mutual_information(comparable(slots, forks, least), "slot", "fork")
    return ami.groupBy("slot").agg(F.min(F.struct((-F.col("ami")).alias("m"), "fork", "n"))["fork"].alias("fork"), F.max("ami").alias("ami"))


def best_match(items: DataFrame, by: str = "jaccard") -> DataFrame:
    """Per cluster of a the cluster of b that shares most of it: by items shared, then Jaccard; or by containment, then items shared."""
    c = contingency(items)
    jaccard, inside = F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), F.col("n") / F.least("na", "nb")
    c = c.withColumn("jaccard", jaccard).withColumn("containment", inside)
    rank = [(-F.col("n")).alias("p"), (-F.col("jaccard")).alias("q")] if by == "jaccard" else [(-F.col("containment")).alias("p"), (-F.col("n")).alias("q")]
    best = c.groupBy("a").agg(F.min(F.struct(*rank, "b", "n", F.round("jaccard", 6).alias("j"), F.round("containment", 6).alias("c"))).alias("x"))
    return best.select("a", "x.b", "x.n", F.col("x.j").alias("jaccard"), F.col("x.c").alias("containment"))


def remapped(edges: DataFrame, mapping: DataFrame, other: DataFrame) -> DataFrame:
    """Undirected edges (x, y, n) whose ends another build knows too (mapping: fork, to), with that build's traffic, 0 where it has none."""
    m = lambda c, to: mapping.select(F.col("fork").alias(c), F.col("to").alias(to))
    t = edges.join(m("x", "tx"), "x").join(m("y", "ty"), "y").filter("tx <> ty").select("x", "y", "n", F.least("tx", "ty").alias("u"), F.greatest("tx", "ty").alias("v"))
    return t.join(other.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("n").alias("m")), ["u", "v"], "left").select("x", "y", "u", "v", "n", F.coalesce("m", F.lit(0)).alias("m"))


def drift(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """Forks (fork, coverage, eff_reached) of one build against their best matches (a, b, containment) in another: differences, and what
    became of them: scattered (none holds half), merged (several meet in one) or matched."""
    many = mapping.groupBy("b").agg(F.count("*").alias("k"))
    t = before.join(mapping.select(F.col("a").alias("fork"), "b", "containment"), "fork").join(many, "b")
    t = t.join(after.select(F.col("fork").alias("b"), F.col("coverage").alias("c"), F.col("eff_reached").alias("e")), "b", "left")
    event = F.when(F.col("containment") < 0.5, "scattered").when(F.col("k") > 1, "merged").otherwise("matched")
    return t.select("fork", "b", F.round(F.col("c") - F.col("coverage"), 6).alias("coverage_delta"), F.round(F.col("e") - F.col("eff_reached"), 6).alias("eff_delta"), event.alias("event"))


def recall_at(scores: DataFrame, truth: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, found, recall: how many of the true pairs (a, b) are among the first `budget` by score."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "a", "b"))
    top = scores.orderBy(F.desc("score"), "a", "b").limit(max(budgets)).withColumn("rank", rank)  # the largest budget's rows
    hit = top.join(truth.select("a", "b").distinct(), ["a", "b"])
    n = truth.select("a", "b").distinct().agg(F.count("*").alias("n"))
    t = hit.agg(*[F.sum((F.col("rank") <= k).cast("long")).alias(f"k{k}") for k in budgets]).crossJoin(n)  # one row each
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("budget"), F.coalesce(F.col(f"k{k}"), F.lit(0)).alias("found"), F.round(F.coalesce(F.col(f"k{k}"), F.lit(0)) / F.col("n"), 6).alias("recall")) for k in budgets])).alias("x")).select("x.*")


def variance_split(pairs: DataFrame) -> DataFrame:
    """pairs (parent_a, parent_b, value) of replicates: mean and standard deviation within one parent and between two, and the share of the
    loss of agreement that is there already within one."""
    same = F.col("parent_a") == F.col("parent_b")
    v = lambda c: F.when(c, F.col("value"))
    t = pairs.agg(F.avg(v(same)).alias("w"), F.stddev_samp(v(same)).alias("ws"), F.avg(v(~same)).alias("b"), F.stddev_samp(v(~same)).alias("bs"))
    return t.select(F.round("w", 6).alias("within"), F.round("ws", 6).alias("within_sd"), F.round("b", 6).alias("between"), F.round("bs", 6).alias("between_sd"), F.round(F.when(F.col("b") < 1, (1 - F.col("w")) / (1 - F.col("b"))), 6).alias("induction_share"))


def cluster_overlaps(items: DataFrame) -> DataFrame:
    """i, j, jaccard, containment of clusters of a and b that share items."""
    c = contingency(items)
    return c.select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"), (F.col("n") / F.least("na", "nb")).alias("containment"))


#: The levels at which clusters match.
LEVELS = (("verbatim", "jaccard", 1.0), ("strict", "jaccard", 0.9), ("lenient", "jaccard", 0.5), ("core", "containment", 0.5))


def matched_levels(items: DataFrame) -> DataFrame:
    """level, matched, precision, recall, f1 of one-to-one matches of clusters, best first, at four levels."""
    pairs = cut(cluster_overlaps(items))
    n = items.agg(F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"))
    out = None
    for level, score, least in LEVELS:
        m = one_to_one(pairs.filter(F.col(score) >= least).select("i", "j", F.col(score).alias("s"))).agg(F.count("*").alias("m")).crossJoin(n)  # one row each
        p, r = F.col("m") / F.col("nb"), F.col("m") / F.col("na")
        row = m.select(F.lit(level).alias("level"), F.col("m").alias("matched"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(F.col("m") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))
        out = row if out is None else out.union(row)
    return out


def line_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per run: the adjusted Rand index of two partitions of its lines (run, id, start, end, kind), the share of lines whose kinds agree, and
    the difference of the numbers of spans."""
    lines = lambda s, n: s.select("run", "id", "kind", F.explode(F.sequence("start", "end")).alias("line")).groupBy("run", "line").agg(F.min("id").alias(n), F.min_by("kind", "id").alias(f"k{n}"))
    t = lines(a, "a").join(lines(b, "b"), ["run", "line"])
    kinds = t.groupBy("run").agg(F.round(F.avg((F.col("ka") == F.col("kb")).cast("double")), 6).alias("kinds"))
    count = lambda s, n: s.groupBy("run").agg(F.count("*").alias(n))
    delta = count(a, "x").join(count(b, "y"), "run").select("run", (F.col("y") - F.col("x")).alias("spans_delta"))
    return adjusted_rand(t, "run").join(kinds, "run").join(delta, "run").select("run", "items", "ari", "kinds", "spans_delta")


def by_size(items: DataFrame, over: str, cuts: tuple[int, int] = (12, 20)) -> DataFrame:
    """Per bucket of groups by their numbers of items: groups, and the mean and median of their adjusted Rand indices."""
    a = adjusted_rand(items, over).filter("ari is not null")
    low, high = cuts
    name = F.when(F.col("items") < low, f"<{low}").when(F.col("items") < high, f"{low}-{high - 1}").otherwise(f"{high}+")
    return a.groupBy(name.alias("bucket")).agg(F.count("*").alias("groups"), F.round(F.avg("ari"), 6).alias("mean"), F.round(F.median("ari"), 6).alias("median"))


def verdict(items: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """direction() with one verdict: what both ways of looking say, ambiguous where they contradict each other."""
    d = direction(items, tolerance)
    x, y = F.col("by_items"), F.col("by_clusters")
    return d.withColumn("verdict", F.when(x == y, x).when(x == "even", y).when(y == "even", x).otherwise("ambiguous"))
