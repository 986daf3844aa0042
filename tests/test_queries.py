"""Queries agree with their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["a1_fork_stats", "a12_path_space", "g17_cramers_v", "a29_ari", "w2_returns", "j10_overlaps", "j3_presence", "m1_levels", "g4_gates", "a26_tally", "a41_ami", "j1_members", "audit_vocabulary", "x17_against_builds", "st_sessions", "f_thresholds", "st_islands_batch", "lineage_neighbours", "g19_silhouettes", "g14_options", "f_json", "x21_codebook"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    from manyways.plans import QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name].run(spark, SF).toPandas(), con.execute(QUERIES[name].sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_names_have_sql_of_their_own():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
