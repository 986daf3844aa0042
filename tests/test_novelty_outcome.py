"""The rank correlation of novelty and outcome is that of the novelty scores."""

import numpy as np
import pytest

from manyways.model import orders_choice
from manyways.operators import forks
from manyways.plans import QUERIES


def ranks(x):
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def test_novelty_scores_are_what_is_ranked(spark, tmp_path):
    import duckdb

    runs = range(1, 25)
    own = [(100 + r, "PROMO", 5, f"Brand#{r}") for r in runs if r % 3 == 0]  # options of one run
    tables = {
        "customer": ([(r, "BUILDING") for r in runs], "c_custkey long, c_mktsegment string"),
        "part": ([(1, "PROMO", 5, "all"), (2, "SMALL", 5, "all"), *own], "p_partkey long, p_type string, p_size int, p_brand string"),
        "orders": ([(r, r, float((r * 7) % 11 + 3 * (r % 3 == 0))) for r in runs], "o_orderkey long, o_custkey long, o_totalprice double"),
        "lineitem": ([(r, p, 1, k, "1995-01-01") for r in runs for k, p in enumerate([1] + [2] * (r % 5) + [100 + r] * (r % 3 == 0))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string"),
    }
    con = duckdb.connect()
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query = QUERIES["a18_novelty_outcome"]
    got = [tuple(r) for r in query.run(spark, str(tmp_path)).collect()]
    price = {k: y for _, k, y in tables["orders"][0]}
    rows = forks.run_novelty(orders_choice(spark, str(tmp_path))).collect()
    x, y = ranks([r.score for r in rows]), ranks([price[r.run] for r in rows])
    assert x.std() > 0 and got == [(24, pytest.approx(np.corrcoef(x, y)[0, 1], abs=2e-6))] and con.execute(query.sql).fetchall() == got
    assert got[0][1] != pytest.approx(np.corrcoef(ranks([r.decisions for r in rows]), y)[0, 1], abs=1e-3)
