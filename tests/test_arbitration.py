"""Arbitration on a handful of decisions."""

from manyways.operators import arbitration


def test_classes_inherit_from_their_largest_cluster(spark):
    labels = lambda text: spark.createDataFrame([(i, c) for i, c in enumerate(text) if c != "-"], "did long, label string")
    builds = [labels("aaaaabb-cc"), labels("xxyyyxxx-z"), labels("1111111111")]
    shared = arbitration.shared_labels(builds)
    assert {r.did: tuple(r.labels) for r in shared.collect()} == {0: ("a", "x", "1"), 1: ("a", "x", "1"), 2: ("a", "y", "1"), 3: ("a", "y", "1"), 4: ("a", "y", "1"), 5: ("b", "x", "1"), 6: ("b", "x", "1"), 9: ("c", "z", "1")}
    assert tuple(arbitration.report(shared).first()) == (8, 3, 4, 1, round(1 / 3, 6), 1)
    assert {r.build: r.clusters for r in arbitration.cluster_counts(shared).collect()} == {1: 3, 2: 3, 3: 1}
    decisions = spark.createDataFrame([(i, f"r{i % 2}") for i in range(10)], "did long, run string")
    owners = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 2), (4, 2), (4, 1), (9, 7)], "did long, oid long")
    options = spark.createDataFrame([(1, "one", "f"), (2, "two", "g")], "oid long, option string, fork string")
    got = {tuple(r.arbitrated_from): (r.n, r.runs, r.first_did, r.oid, r.option, r.fork) for r in arbitration.arbitrated(shared, decisions, owners, options).collect()}
    assert got == {
        ("a", "x", "1"): (2, 2, 0, 1, "one", "f"),  # a tie: the owner of the first decision
        ("a", "y", "1"): (3, 2, 2, 2, "two", "g"),
        ("b", "x", "1"): (2, 2, 5, None, None, None),
        ("c", "z", "1"): (1, 1, 9, 7, None, None),
    }
    assert arbitration.report(shared.limit(0)).first().clusters_after == 0
