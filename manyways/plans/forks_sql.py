"""Queries on forks, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyways.model import CHOICE_SQL, Query, on_events, on_orders, orders_choice
from manyways.operators import forks

STATS = """, picks AS (SELECT fork, run, option, count(*) n, min(line) seen FROM choice GROUP BY ALL),
modal AS (SELECT fork, run, option FROM (SELECT *, row_number() OVER (PARTITION BY fork, run ORDER BY n DESC, seen) rn FROM picks) WHERE rn = 1),
votes AS (SELECT fork, option, count(*) c FROM modal GROUP BY ALL),
total AS (SELECT count(DISTINCT run) n FROM choice),
stats AS (
  SELECT fork, sum(c)::BIGINT reach, (any_value(n) - sum(c))::BIGINT absent, round(sum(c) / any_value(n), 6) coverage, round(sum(c) * sum(c) / sum(c * c), 6) eff_reached,
    round(any_value(n) * any_value(n) / (sum(c * c) + (any_value(n) - sum(c)) * (any_value(n) - sum(c))), 6) eff_all, count(*) options, round(max(c) / sum(c), 6) modal_share
  FROM votes, total GROUP BY fork),
option_runs AS (SELECT fork, option, count(DISTINCT run) c FROM choice GROUP BY ALL),
reach AS (SELECT fork, count(DISTINCT run) runs FROM choice GROUP BY fork)
"""
POSITION = """, placed AS (SELECT fork, line / max(line) OVER (PARTITION BY run) p FROM choice),
position AS (SELECT fork, round(list_sort(list(p))[(floor(count(*) / 2) + 1)::INT], 6) position FROM placed GROUP BY fork)
"""
NOVEL = """, novel AS (SELECT fork, option FROM option_runs JOIN reach USING (fork) WHERE c = 1 AND runs >= 10),
held AS (SELECT run, count(*) k FROM (SELECT DISTINCT run, fork, option FROM choice) JOIN novel USING (fork, option) GROUP BY run),
scores AS (SELECT p.run, p.arm, p.decisions, COALESCE(k, 0) novel, round(COALESCE(k, 0) / p.decisions, 6) score
  FROM (SELECT run, any_value(arm) arm, count(*) decisions FROM choice GROUP BY run) p LEFT JOIN held USING (run))
"""

STAGE_SQL = """st AS (SELECT fork, CASE split_part(fork, '/', 1) WHEN 'PROMO' THEN 'data' WHEN 'LARGE' THEN 'transformation' WHEN 'SMALL' THEN 'inference' END stage FROM (SELECT DISTINCT fork FROM choice) WHERE split_part(fork, '/', 1) IN ('PROMO', 'LARGE', 'SMALL'))"""


def stages(spark, sf_dir):
    """Stages of forks by a word of their names; others have none."""
    f = orders_choice(spark, sf_dir).select("fork").distinct()
    kind = F.substring_index("fork", "/", 1)
    return f.withColumn("stage", F.when(kind == "PROMO", "data").when(kind == "LARGE", "transformation").when(kind == "SMALL", "inference")).dropna()


def types(spark, sf_dir):
    """Forks and the part type that heads them."""
    return orders_choice(spark, sf_dir).select("fork", F.substring_index("fork", "/", 1).alias("head")).distinct()


QUERIES = {
    "a1_fork_stats": on_orders(forks.fork_stats, STATS + "SELECT * FROM stats"),
    "p5_pivotal": on_orders(forks.pivotal, STATS + "SELECT * FROM stats WHERE reach >= 10 AND eff_all > 1.5"),
    "p7_qualifying": on_orders(forks.qualifying, STATS + "SELECT fork, coverage, eff_reached FROM stats WHERE coverage >= 0.25 AND eff_reached > 1.5"),
    "w1_modal": on_orders(forks.modal, STATS + "SELECT * FROM modal"),
    "a2_stability": on_orders(forks.stability, STATS + """SELECT fork, max(runs) runs, count(*) options, round(max(c) / max(runs), 6) modal_share, round(sum(c * c) / (sum(c) * sum(c)), 6) hhi,
        count(*) FILTER (c >= greatest(3, 0.10 * runs)) stable_options, count(*) FILTER (c = 1) novel_options, round(avg((c = 1)::INT), 6) novel_share, string_agg(c::VARCHAR, ',' ORDER BY c DESC) counts
        FROM option_runs JOIN reach USING (fork) WHERE runs >= 10 GROUP BY fork"""),
    "a3_spectrum": on_orders(forks.spectrum, STATS + "SELECT c k, count(*) options FROM option_runs GROUP BY c"),
    "a4_provenance_delta": on_orders(forks.provenance_delta, """, c2 AS (SELECT 'all' which, * FROM choice UNION ALL SELECT 'without' which, * FROM choice WHERE arm NOT IN ('BUILDING', 'MACHINERY')),
        picks AS (SELECT which, fork, run, option, count(*) n, min(line) seen FROM c2 GROUP BY ALL), modal AS (SELECT which, fork, run, option FROM (SELECT *, row_number() OVER (PARTITION BY which, fork, run ORDER BY n DESC, seen) rn FROM picks) WHERE rn = 1),
        votes AS (SELECT which, fork, option, count(*) c FROM modal GROUP BY ALL), per AS (SELECT which, fork, sum(c) reach, round(max(c) / sum(c), 6) m, round(sum(c) * sum(c) / sum(c * c), 6) e FROM votes GROUP BY ALL)
        SELECT which, count(*) forks, round(avg(m), 6) modal_share, round(avg(e), 6) eff_reached FROM per WHERE reach >= 10 GROUP BY which""", "BUILDING", "MACHINERY"),
    "a5_arm_richness": on_orders(forks.arm_richness, """, per AS (SELECT fork, option, arm, count(DISTINCT run) c FROM choice GROUP BY ALL), every AS (SELECT fork, option, count(*) arms, sum(c) total FROM per GROUP BY ALL)
        SELECT arm, options, singletons, private, runs, round(options / runs, 6) per_run FROM (SELECT arm, count(*) options, count(*) FILTER (total = 1) singletons, count(*) FILTER (arms = 1) private FROM per JOIN every USING (fork, option) GROUP BY arm)
        JOIN (SELECT arm, count(DISTINCT run) runs FROM choice GROUP BY arm) USING (arm)"""),
    "a7_comparison": on_orders(forks.comparison, STATS + """SELECT count(*) forks, sum(options)::BIGINT options, count(*) FILTER (reach >= 10) measurable, round(median(options) FILTER (reach >= 10), 6) median_options,
        round(median(modal_share) FILTER (reach >= 10), 6) median_modal, round(median(eff_reached) FILTER (reach >= 10), 6) median_eff, count(*) FILTER (reach >= 10 AND modal_share >= 0.8) conventions,
        count(*) FILTER (reach >= 10 AND eff_reached >= 3) contested, count(*) FILTER (coverage >= 0.6) universal, (SELECT count(*) FROM option_runs WHERE c = 1) singles FROM stats"""),
    "a8_flipped": Query(
        lambda spark, d: forks.flipped(orders_choice(spark, d).withColumn("option", F.substring("option", 1, 7)), orders_choice(spark, d)),
        f"""WITH {CHOICE_SQL}, two AS (SELECT 'a' w, fork, run, line, substr(option, 1, 7) option FROM choice UNION ALL SELECT 'b' w, fork, run, line, option FROM choice),
        picks AS (SELECT w, fork, run, option, count(*) n, min(line) seen FROM two GROUP BY ALL), modal AS (SELECT w, fork, run, option FROM (SELECT *, row_number() OVER (PARTITION BY w, fork, run ORDER BY n DESC, seen) rn FROM picks) WHERE rn = 1),
        votes AS (SELECT w, fork, option, count(*) c FROM modal GROUP BY ALL), per AS (SELECT w, fork, sum(c) reach, round(max(c) / sum(c), 6) m FROM votes GROUP BY ALL)
        SELECT x.fork, x.m AS before, y.m AS after FROM per x JOIN per y USING (fork) WHERE x.w = 'a' AND y.w = 'b' AND x.reach >= 10 AND y.reach >= 10 AND (x.m >= 0.8) <> (y.m >= 0.8)""",
    ),
    "a9_positions": on_orders(forks.positions, POSITION + "SELECT fork, count(DISTINCT run) runs, count(DISTINCT option) options, any_value(position) AS position FROM choice JOIN position USING (fork) GROUP BY fork"),
    "a11_node_classes": on_orders(forks.node_classes, STATS + "SELECT CASE WHEN coverage >= 0.6 THEN 'universal' WHEN coverage >= 0.25 THEN 'common' WHEN coverage >= 0.05 THEN 'occasional' ELSE 'rare' END \"class\", count(*) forks FROM stats GROUP BY 1"),
    "a12_path_space": on_orders(forks.path_space, STATS + """, u AS (SELECT fork, options FROM stats WHERE coverage >= 0.6), m AS (SELECT * FROM modal JOIN u USING (fork)),
        r AS (SELECT run, count(*) k, string_agg(fork || '=' || option, '|' ORDER BY fork) path FROM m GROUP BY run),
        z AS (SELECT (SELECT count(*) FROM r WHERE k = (SELECT count(*) FROM u)) complete_runs, (SELECT count(DISTINCT path) FROM r WHERE k = (SELECT count(*) FROM u)) distinct_paths, (SELECT count(*) FROM u) universal_forks,
        (SELECT round(sum(ln(options)), 6) FROM u) log_paths, (SELECT count(*) FROM (SELECT DISTINCT a.fork, a.option, b.fork, b.option FROM m a JOIN m b ON a.run = b.run AND a.fork < b.fork)) pairs_seen) SELECT z.*, round(pairs_seen / (SELECT (sum(options) * sum(options) - sum(options * options)) / 2 FROM u), 6) pair_share FROM z"""),
    "a13_run_novelty": on_orders(forks.run_novelty, STATS + NOVEL + "SELECT * FROM scores"),
    "a14_arm_novelty": on_orders(forks.arm_novelty, STATS + NOVEL + "SELECT arm, count(*) runs, sum(novel)::BIGINT novel, round(sum(novel) / sum(decisions), 6) rate FROM scores GROUP BY arm"),
    "a14_fork_novelty": on_orders(forks.fork_novelty, STATS + "SELECT fork, count(*) FILTER (c = 1) novel, count(*) options, round(count(*) FILTER (c = 1) / count(*), 6) share FROM option_runs JOIN reach USING (fork) WHERE runs >= 10 GROUP BY fork"),
    "a22_vocabulary_report": on_orders(forks.vocabulary_report, STATS + "SELECT fork, decisions, top_share, singleton_rate, runs FROM (SELECT fork, sum(n)::BIGINT decisions, round(max(n) / sum(n), 6) top_share, round(avg((n = 1)::INT), 6) singleton_rate FROM (SELECT fork, option, count(*) n FROM choice GROUP BY ALL) GROUP BY fork) JOIN reach USING (fork)"),
    "a46_atlas": on_orders(forks.atlas, STATS + POSITION + "SELECT fork, coverage, eff_reached, modal_share, (SELECT count(*) FROM option_runs o WHERE o.fork = stats.fork AND c = 1) singletons, position, CASE WHEN coverage >= 0.5 AND eff_reached >= 3 THEN 'live' WHEN coverage >= 0.5 THEN 'convention' WHEN eff_reached >= 3 THEN 'idiosyncratic' ELSE 'rare and settled' END quadrant FROM stats JOIN position USING (fork) WHERE reach >= 10"),
    "a46_atlas_by_event": on_events(forks.atlas, STATS + POSITION + "SELECT fork, coverage, eff_reached, modal_share, (SELECT count(*) FROM option_runs o WHERE o.fork = stats.fork AND c = 1) singletons, position, CASE WHEN coverage >= 0.5 AND eff_reached >= 3 THEN 'live' WHEN coverage >= 0.5 THEN 'convention' WHEN eff_reached >= 3 THEN 'idiosyncratic' ELSE 'rare and settled' END quadrant FROM stats JOIN position USING (fork) WHERE reach >= 10"),
    "x4_stage_medians": Query(lambda s, d: forks.stage_medians(orders_choice(s, d), stages(s, d)), f"WITH {CHOICE_SQL}{STATS}, {STAGE_SQL}, t AS (SELECT COALESCE(stage, 'modeling') stage, eff_reached FROM stats LEFT JOIN st USING (fork) WHERE reach >= 10) SELECT stage, count(*) forks, list_sort(list(eff_reached))[(floor(count(*) / 2) + 1)::INT] AS median, max(eff_reached) largest FROM t GROUP BY stage"),
    "x29_stages": Query(lambda s, d: forks.with_stage(forks.reach(orders_choice(s, d)), stages(s, d)), f"WITH {CHOICE_SQL}{STATS}, {STAGE_SQL} SELECT fork, runs, COALESCE(stage, 'modeling') stage FROM reach LEFT JOIN st USING (fork)"),
    "a10_merged_positions": Query(lambda s, d: forks.merged_positions(orders_choice(s, d), types(s, d)), f"""WITH {CHOICE_SQL}{POSITION}, per AS (SELECT fork, count(DISTINCT run) runs FROM choice GROUP BY fork) SELECT split_part(fork, '/', 1) head, count(*) forks, round(sum(position * runs) / sum(runs), 6) AS position FROM position JOIN per USING (fork) GROUP BY 1"""),
    "a45_fork_sizes": Query(lambda s, d: forks.fork_sizes(orders_choice(s, d), orders_choice(s, d).filter("did % 5 = 0").select("did")), f"WITH {CHOICE_SQL} SELECT fork, count(DISTINCT option) options, count(*) decisions, count(*) FILTER (did % 5 = 0) silent FROM choice GROUP BY fork"),
    "a25_typology": on_orders(lambda c: forks.typology(c.select("option", "arm"), "option", "arm", ["AUTOMOBILE", "BUILDING", "MACHINERY"]), " SELECT option, count(*) FILTER (arm = 'AUTOMOBILE') AUTOMOBILE, count(*) FILTER (arm = 'BUILDING') BUILDING, count(*) FILTER (arm = 'MACHINERY') MACHINERY FROM choice GROUP BY option"),
    "x5_notable": on_orders(forks.notable, STATS + "SELECT fork, round(eff_reached * coverage, 6) weight FROM stats ORDER BY 2 DESC, 1 LIMIT 6"),
    "k2_contested": on_orders(forks.contested, STATS + "SELECT fork, modal_share, reach FROM stats WHERE reach >= 10 ORDER BY modal_share, fork LIMIT 12"),
    "k2_settled": on_orders(forks.contested, STATS + "SELECT fork, modal_share, reach FROM stats WHERE reach >= 10 ORDER BY modal_share DESC, fork LIMIT 8", 8, settled=True),
    "k4_top_options": on_orders(forks.top_options, STATS + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fork ORDER BY c DESC, option) AS rank FROM option_runs) WHERE rank <= 14"),
    "map_option_arms": on_orders(forks.option_arms, ", per AS (SELECT fork, option, arm, count(DISTINCT run) c FROM choice GROUP BY ALL) SELECT fork, option, string_agg(arm || ':' || c::VARCHAR, ',' ORDER BY arm || ':' || c::VARCHAR) arms, sum(c)::BIGINT n FROM per GROUP BY ALL"),
}
