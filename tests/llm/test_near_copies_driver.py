"""What the near-copy stage asks of the driver: plans without keys in them, and no more rounds of components than are needed."""

import random

from planwise.llm import shared, simhash
from planwise.llm.nearcopies import joined_by
from planwise.llm.shared import join_skewed


def written(monkeypatch):
    """The labels of the tables that components() writes from here on."""
    labels = []
    real = shared.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label, keep=False: labels.append(label) or real(df, label, keep))
    return labels


def test_stars_need_no_round(spark, monkeypatch):
    labels = written(monkeypatch)
    edges = [(0, i) for i in range(1, 50)] + [(100, 101), (102, 100)[::-1], (100, 101)]
    roots = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, roots)) == [(i, 0) for i in range(1, 50)] + [(101, 100), (102, 100)]
    assert labels == ["links"]
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    edges += edges[:40] + [(b, a) for a, b in edges[:40]]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, r) for x, r in root.items() if x != r)


def test_pairs_join_the_stars_found_so_far(spark, monkeypatch):
    roots = spark.createDataFrame([(2, 1), (3, 1), (6, 5), (7, 5), (9, 8)], "node long, root long")
    labels = written(monkeypatch)
    none = joined_by(roots, spark.createDataFrame([], "a long, b long"))
    assert sorted(map(tuple, none.collect())) == [(2, 1), (3, 1), (6, 5), (7, 5), (9, 8)] and not labels
    both = joined_by(roots, spark.createDataFrame([(3, 7), (20, 30)], "a long, b long"))
    assert sorted(map(tuple, both.collect())) == [(2, 1), (3, 1), (5, 1), (6, 1), (7, 1), (9, 8), (30, 20)]


def test_hot_keys_are_not_in_the_plan(spark):
    keys = [(1 << 40) + i for i in range(400)]
    left = spark.createDataFrame([(k, i) for k in keys for i in range(2)] + [(None, 0), (7, 7)], "key long, i long")
    right = spark.createDataFrame([(k, f"v{k}", 2) for k in keys] + [(None, "none", 1), (8, "other", 0)], "key long, v string, rows long")
    joined = join_skewed(left, right, "key", "rows")
    assert joined.columns == ["key", "i", "v"]
    assert sorted(map(tuple, joined.collect())) == [(k, i, f"v{k}") for k in keys for i in range(2)]
    assert str((1 << 40) + 5) not in joined._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0]
    assert "INSET" not in joined._jdf.queryExecution().optimizedPlan().toString()
