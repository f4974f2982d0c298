"""Arms, the index filter, names in texts beyond a broadcast, and whole tables in place of named indexes."""

import pytest

from planwise.operators import candidates, models, querylog, report
from planwise.plans import planlog
from planwise.registry import QUERIES
from planwise.sources import adapters


def test_arms_by_hand(spark):
    roles = spark.createDataFrame(
        [(1, "predicates", "t", "a", 1), (1, "predicates", "t", "b", 2), (1, "payload", "t", "c", 3), (1, "payload", "u", "x", 1), (1, "predicates", "small", "s", 1)],
        "query_id long, role string, tab string, col string, pos long",
    )
    rows = spark.createDataFrame([("t", 20_000), ("u", 10_000), ("small", 9_999)], "tab string, rows long")
    shares = spark.createDataFrame([(1, "t", 0.25)], "query_id long, tab string, selectivity double")
    found = {r["index_id"]: (r["value"], r["whole"]) for r in candidates.bandit_arms(roles, shares, rows).collect()}
    assert found == {"t#a": (7500.0, False), "t#b": (7500.0, False), "t#a,b": (15000.0, True), "t#b,a": (15000.0, True), "u#x": (10.0, True)}
    assert candidates.bandit_arms(roles.limit(0), shares, rows).count() == 0


def test_names_have_one_meaning_at_every_size(spark, sf_dir, monkeypatch):
    queries = spark.createDataFrame(
        [(1, "select t.col, ab from t, u where xcold > 1"), (2, "SELECT AB FROM U"), (3, "select \"o dd\" from t"), (4, ""), (5, None)], "query_id long, sql string"
    )
    catalog = spark.createDataFrame([("t", "col"), ("u", "col"), ("u", "ab"), ("t", "o dd")], "tab string, col string")
    whole = (queries, catalog), (querylog.prepared(spark, sf_dir), adapters.catalog(spark, sf_dir))
    small = [sorted(map(tuple, querylog.indexable_columns(*w).collect())) for w in whole]
    monkeypatch.setattr(querylog, "BROADCAST_COLUMNS", 0)
    assert [sorted(map(tuple, querylog.indexable_columns(*w).collect())) for w in whole] == small
    assert small[0] == [(1, "t", "col"), (1, "u", "ab"), (2, "u", "ab"), (3, "t", "o dd")]


def test_shares_on_a_half_are_rounded_as_in_sql(spark):
    """0.0039875 and 0.0001245 lie on a half at six places only as text; beyond 0.1 GB tables have such row counts."""
    import duckdb

    nodes = spark.createDataFrame([(1, 0, -1, "Seq Scan", 4785.0, "part"), (2, 0, -1, "Index Scan", 4482.0, "lineitem")], "plan_id long, node_id int, parent_id int, node_type string, plan_rows double, relation string")
    rows = spark.createDataFrame([("part", 1_200_000), ("lineitem", 36_000_000)], "tab string, rows long")
    want = duckdb.sql("select round(4785::double / 1200000, 6), round(4482::double / 36000000, 6)").fetchall()[0]
    assert tuple(r["most"] for r in planlog.operator_selectivities(nodes, rows).orderBy("plan_id").collect()) == want
    assert tuple(r["selectivity"] for r in planlog.table_selectivity(nodes, rows).orderBy("plan_id").collect()) == want


def test_filter_vector_by_hand(spark):
    vectors = spark.createDataFrame([(1, [float(i) for i in range(52)])], "plan_id long, features array<double>")
    utility = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25)], "plan_id long, col string, utility double")
    shapes = spark.createDataFrame([(1, "t#a,b", "join,-"), (1, "t#c", "order-by")], "query_id long, index_id string, shape string")
    indexes = spark.createDataFrame([("t#a,b", ["a", "b"]), ("t#c", ["c"])], "index_id string, cols array<string>")
    found = {r["index_id"]: r["features"] for r in planlog.index_filter_vectors(vectors, utility, shapes, indexes).collect()}
    middle, last = [float(i) for i in range(42)], [float(i) for i in range(42, 52)]
    assert found == {"t#a,b": [0.75, *middle, 4.0, 0.0, *last], "t#c": [0.0, *middle, 1.0, 0.0, *last]}


def test_filter_learns_gains_of_queries_it_has_not_seen(spark):
    """Labels that follow from the utility and the first selectivity; a third of the pairs have no label."""
    rows = [(q, f"t#{i}", [(q * 37 + i * 11) % 100 / 100, *[0.0] * 44, (q * 53 + i) % 100 / 100, *[0.0] * 9]) for q in range(300) for i in range(3)]
    vectors = spark.createDataFrame(rows, "plan_id long, index_id string, features array<double>")
    labels = spark.createDataFrame([(q, i, v[0] if v[45] < 0.5 else 0.0) for q, i, v in rows if i != "t#2"], "query_id long, index_id string, label double")
    model, known = models.fit_index_filter(vectors, labels)
    scored = model.transform(known).collect()
    unseen = [r for r in scored if r["split"] == "valid" and r["label"] is not None]
    mean = sum(r["label"] for r in unseen) / len(unseen)
    error, plain = (sum((r["label"] - g(r)) ** 2 for r in unseen) for g in (lambda r: r["prediction"], lambda r: mean))
    assert len(scored) == 900 and sum(r["label"] is None for r in scored) == 300 and error < plain / 2


@pytest.mark.parametrize("name", ["index_operator_features", "pad_and_mask"])
def test_every_index_is_there(spark, sf_dir, name):
    whole = {r[0] for r in planlog.op_features_of(spark, sf_dir).select("index_id").distinct().collect()}
    assert len(whole) > 3 and {r[0] for r in QUERIES[name](spark, sf_dir).select("index_id").distinct().collect()} == whole


def test_pivot_takes_every_batch(spark):
    rows = spark.createDataFrame([("x", 1, 2.0), ("x", 7, 4.0), ("x", 7, 2.0), ("y", 1, 1.0)], "name string, batch int, value double")
    assert {r["name"]: tuple(r)[1:] for r in report.measure_pivot(rows).collect()} == {"x": (2.0, 3.0, 5.0), "y": (1.0, 0.0, 1.0)}
    assert report.measure_pivot(rows, [1]).columns == ["name", "b1", "total"]
