"""Hand-made cases of the operators, and properties that hold for every input."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwise.functions import sqltext
from planwise.operators import candidates, cost, drift, models, profile, querylog, select
from planwise.plans import planlog
from planwise.sources import adapters, files
from planwise.streaming import rounds

PLAN = {
    "Node Type": "Aggregate", "Total Cost": 90, "Plan Rows": 4,
    "Plans": [{
        "Node Type": "Merge Join", "Total Cost": 70, "Plan Rows": 60,
        "Plans": [
            {"Node Type": "Sort", "Total Cost": 25, "Plan Rows": 300, "Plans": [{"Node Type": "Seq Scan", "Total Cost": 12, "Plan Rows": 300}]},
            {"Node Type": "Nested Loop", "Total Cost": 33, "Plan Rows": 80, "Plans": [{"Node Type": "Index Scan", "Total Cost": 7, "Plan Rows": 80}, {"Node Type": "Seq Scan", "Total Cost": 5, "Plan Rows": 40}]},
        ],
    }],
}


def test_plan_walk_gives_heights_and_weighted_sums():
    nodes = sorted(planlog.plan_rows(1, json.dumps(PLAN)), key=lambda n: n["post_id"])
    assert [n["height"] for n in nodes] == [1, 2, 1, 1, 2, 3, 4]
    # sort 1 x 12; loop 7 + 5; join 2 x 12 + 2 x 12; aggregate 3 x 48
    assert [n["w_cost"] for n in nodes] == [12, 12, 7, 5, 12, 48, 144]
    # sort 1 x 300; loop 80 + 40; join 2 x 300 + 2 x 120; aggregate 3 x 840
    assert [n["w_rows"] for n in nodes] == [300, 300, 80, 40, 120, 840, 2520]


def test_plan_channels_and_single_node(spark):
    plans = spark.createDataFrame([(1, json.dumps(PLAN)), (2, json.dumps({"Node Type": "Result"})), (3, None)], "plan_id long, plan string")
    found = {r["plan_id"]: r for r in planlog.plan_channels(planlog.flatten_plan(plans)).collect()}
    join, scan = planlog.CHANNEL_TYPES.index("Merge Join"), planlog.CHANNEL_TYPES.index("Seq Scan")
    assert [found[1][c][join] for c in ("cost", "rows", "w_cost", "w_rows")] == [70, 60, 48, 840]
    assert [found[1][c][scan] for c in ("cost", "rows", "w_cost", "w_rows")] == [17, 340, 17, 340]
    assert sum(found[1]["cost"]) == 242 and set(found) == {1, 2}


def test_a_deep_plan_needs_no_recursion():
    deep = {"Node Type": "Seq Scan", "Total Cost": 1, "Plan Rows": 1}
    text = json.dumps(deep)
    for _ in range(300):
        text = '{"Node Type":"Sort","Total Cost":1,"Plan Rows":1,"Plans":[' + text + "]}"
    nodes = planlog.plan_rows(1, text)
    assert len(nodes) == 301 and nodes[0]["height"] == 301


def indexes(spark, *ids):
    return spark.createDataFrame([(i, i.split("#")[0], i.split("#")[1].split(",")) for i in ids], "index_id string, tab string, cols array<string>").withColumn("width", F.size("cols"))


def test_index_algebra(spark):
    two = indexes(spark, "t#a,b", "t#b,c", "t#d")
    merged = {(r["a"], r["b"]): r["merged"] for r in candidates.merge_candidates(two, 3).collect()}
    assert merged["t#a,b", "t#b,c"] == "t#a,b,c" and merged["t#b,c", "t#a,b"] == "t#b,c,a"
    assert [tuple(r) for r in candidates.split_candidates(two).collect()] == [("t#a,b", "t#b,c", "b", "a", "c")]
    three = indexes(spark, "t#a,b,c", "t#a", "t#b")
    assert [r["prefix_id"] for r in candidates.prefix_candidates(three).orderBy("rank").collect()] == ["t#a,b", "t#a"]
    assert [tuple(r) for r in candidates.subsumed_pairs(three).collect()] == [("t#a,b,c", "t#a")]
    columns = spark.createDataFrame([("t", "a"), ("t", "b")], "tab string, col string")
    assert [r["extended"] for r in candidates.extend_candidates(indexes(spark, "t#a"), columns).collect()] == ["t#a,b"]


def test_greedy_skips_what_does_not_fit(spark):
    rated = spark.createDataFrame([("t#a", 40.0, 4, 1), ("t#b", 45.0, 5, 1), ("t#c", 5.0, 1, 1)], "index_id string, benefit double, size_bytes long, width int").withColumn("ratio", F.col("benefit") / F.col("size_bytes"))
    assert [r["index_id"] for r in cost.select_benefit_greedy(rated, 5).collect()] == ["t#a", "t#c"]
    assert cost.select_benefit_greedy(rated, 0).count() == 0


def test_combine_subsumed_walks_by_ratio(spark):
    rated = spark.createDataFrame([("t#a,b", 90.0, 10, 2), ("t#a", 30.0, 5, 1), ("t#b", 10.0, 5, 1)], "index_id string, benefit double, size_bytes long, width int").withColumn("ratio", F.col("benefit") / F.col("size_bytes"))
    assert {r["index_id"]: r["benefit"] for r in cost.combine_subsumed(rated).collect()} == {"t#a,b": 120.0, "t#b": 10.0}


def test_q_error_and_change(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (1.0, 4.0), (3.0, 3.0)], "pred double, truth double")
    s = models.q_error_summary(rows).first()
    assert (s["mean"], s["median"], s["largest"]) == (2.3333, 2.0, 4.0)
    change = rounds.workload_change(spark.createDataFrame([(1, 0, 1), (2, 4, 0)], "round_id int, past long, new long")).orderBy("round_id").collect()
    assert [r["change"] for r in change] == [1.0, 0.25]
    factor = rounds.forget_factor(spark.createDataFrame([(1, 0.25), (2, 0.6), (3, 0.0)], "round_id int, change double")).orderBy("round_id").collect()
    assert [(r["factor"], r["reset_exploration"]) for r in factor] == [(0.5, True), (0.0, True), (1.0, False)]


def test_equi_depth(spark):
    freq = spark.createDataFrame([("c", i, f) for i, f in enumerate([0.0, 0.25, 0.25, 0.25, 0.25])], "col string, pos int, freq double")
    assert [r["boundary"] for r in profile.equi_depth_bins(freq, 4).orderBy("bin").collect()] == [0, 1, 2, 3, 4]
    heavy = spark.createDataFrame([("c", 0, 9.0), ("c", 1, 0.0), ("c", 2, 8.0), ("c", 3, 2.0)], "col string, pos int, freq double")
    assert [r["boundary"] for r in profile.equi_depth_bins(heavy, 5).orderBy("bin").collect()] == [1, 2, 2, 2, 2, 3]


@pytest.mark.parametrize(
    "sql,shape",
    [("SELECT a FROM t WHERE b = 1;", "n"), ("select a\nfrom t", "s"), ("select a from t where b > 1 group by a having c > 1 order by a", "wgho"), ("select a from t group by a order by a", "go"), ("select a from t order by a", "o")],
)
def test_shapes(spark, sql, shape):
    text = sqltext.normalize(F.col("sql"))
    assert spark.createDataFrame([(sql,)], "sql string").select(sqltext.shape(text)).first()[0] == shape


def test_normal_form(spark):
    given = "SELECT  a FROM t\nWHERE d > 30 days) LIMIT -1;"
    assert spark.createDataFrame([(given,)], "sql string").select(sqltext.normalize(F.col("sql"))).first()[0] == "select a from t where d > interval '30 days')"


def test_decode_rules(spark):
    catalog = spark.createDataFrame([("t", "a"), ("t", "b")], "tab string, col string").withColumn("type", F.lit("integer")).withColumn("ordinal", F.lit(1))
    queries = spark.createDataFrame([(1, "select a , b from t where a != 1 or b > xyz")], "query_id long, sql string")
    typed = querylog.typed_tokens(querylog.token_rows(queries), catalog)
    assert querylog.decode_tokens(typed).first()["sql"] == "select a, b from t where a = 1 and b > 'xyz'"


def test_ambiguous_columns_need_their_table(spark):
    catalog = spark.createDataFrame([("t", "id"), ("u", "id"), ("t", "x")], "tab string, col string")
    queries = spark.createDataFrame([(1, "select t.id from t , u where x = 1"), (2, "select id from t")], "query_id long, sql string")
    for words in (False, True):
        assert sorted(tuple(r) for r in querylog.indexable_columns(queries, catalog, words).collect()) == [(1, "t", "id"), (1, "t", "x")]


def test_cost_proportion_and_empty_inputs(spark):
    assert round(150 / 200 * 100, 2) == 75.0
    none = spark.createDataFrame([], "query_id long, tab string, col string")
    assert candidates.candidates_per_query(none).count() == 0 and candidates.index_combinations(candidates.candidates_per_query(none)).count() == 0
    assert querylog.tfidf(spark.createDataFrame([], "query_id long, term string, n long")).count() == 0


def test_stats_of_nulls_and_of_no_rows(spark):
    kinds = {"a": "integer", "b": "character varying"}
    df = spark.createDataFrame([(1, "x"), (None, None), (1, "yy")], "a int, b string")
    found = {r["col"]: r for r in profile.column_stats(df, "t", kinds).collect()}
    assert (found["a"]["null_frac"], found["a"]["ndv"], found["b"]["width"]) == (0.3333, 1, 1.5)
    near = {r["col"]: r["ndv"] for r in profile.column_stats(df, "t", kinds, approximate=True).collect()}
    assert near == {"a": 1, "b": 2}
    assert profile.minmax_normalize(spark.createDataFrame([(5.0,), (5.0,)], "v double"), ["v"]).first()["v"] == 0.0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "w.json").write_text('[[7, "select a from t", 3], "select b from t", {"sql": "select c from t"}]')
    got = files.read_workload(spark, f"file://{tmp_path}/w.json", "json").collect()
    assert [tuple(r) for r in got] == [(7, "select a from t", 3), (1, "select b from t", None), (2, "select c from t", None)]
    (tmp_path / "w.sql").write_text("select a from t\n\nselect b from t\n")
    assert [r["sql"] for r in files.read_workload(spark, f"file://{tmp_path}/w.sql", "sql").collect()] == ["select a from t", "select b from t"]
    (tmp_path / "c.json").write_text(json.dumps([{"table": "t", "rows": 5, "columns": [{"name": "a", "type": "integer"}]}]))
    assert [tuple(r) for r in files.read_catalog(spark, f"file://{tmp_path}/c.json").collect()] == [("t", "a", 1, "integer", 5)]
    (tmp_path / "t.tbl").write_text("1|x\n2|\n")
    assert [tuple(r) for r in files.load_delimited(spark, f"file://{tmp_path}/t.tbl", "a int, b string").collect()] == [(1, "x"), (2, None)]
    record = spark.createDataFrame([("select 1", ["t#a"], 2.0, 1.0, 2.0, 1.0, None, None, "src", "train")], files.COST_SCHEMA + ", fold string, split string")
    files.write_result(record, f"file://{tmp_path}/log", "json", ["fold", "split"])
    back = files.read_cost_log(spark, f"file://{tmp_path}/log").first()
    assert (back["fold"], back["split"], back["indexes"]) == ("src", "train", ["t#a"])
    assert os.path.isdir(tmp_path / "log" / "fold=src" / "split=train")


def test_stream_equals_batch_and_drops_late_rows(spark, sf_dir, tmp_path):
    arrivals = rounds.templated(spark, sf_dir).select("query", "ts", "freq").orderBy("ts").coalesce(1)
    arrivals.write.parquet(f"file://{tmp_path}/in/1")
    batch = rounds.round_windows(arrivals, "6 hours")
    stream = rounds.arrivals_stream(spark, f"file://{tmp_path}/in/*", "query string, ts timestamp, freq long")
    done = rounds.run_to_end(rounds.stream_round_windows(stream, "6 hours", "1 hour"), f"file://{tmp_path}/windows", f"file://{tmp_path}/c1")
    last = batch.agg(F.max("round_start")).first()[0]
    assert {tuple(r) for r in done.collect()} | {tuple(r) for r in batch.where(F.col("round_start") == last).collect()} == {tuple(r) for r in batch.collect()}
    spark.createDataFrame([("late", arrivals.first()["ts"], 1)], "query string, ts timestamp, freq long").write.parquet(f"file://{tmp_path}/in/2")
    again = rounds.run_to_end(rounds.stream_round_windows(stream, "6 hours", "1 hour"), f"file://{tmp_path}/windows", f"file://{tmp_path}/c1")
    assert not any(r["arrivals"] == 1 for r in again.collect())
    lives = rounds.run_to_end(rounds.stream_query_store(stream, "1 day", "1 hour"), f"file://{tmp_path}/lives", f"file://{tmp_path}/c2")
    assert lives.count() > 0 and lives.where("life_end <= life_start").count() == 0
    first = rounds.run_to_end(rounds.stream_distinct_queries(stream, "60 days"), f"file://{tmp_path}/firsts", f"file://{tmp_path}/c3")
    assert first.count() == first.select("query").distinct().count() > 0


def test_selectors_keep_their_promises(spark, sf_dir):
    sized, scans, accesses, weights = (d.cache() for d in select.inputs(spark, sf_dir))
    bytes_ = select.budget(spark, sf_dir, 0.5)
    sizes = {r["index_id"]: r["size_bytes"] for r in sized.collect()}
    steps = select.select_extend(sized, scans, accesses, weights, bytes_, most=3).orderBy("step").collect()
    costs = [r["cost"] for r in steps]
    assert steps and costs == sorted(costs, reverse=True) and {r["index_id"] for r in steps} <= set(sizes)
    kept = [i for i in (r["index_id"] for r in steps) if not any(j.startswith(i + ",") for j in (r["index_id"] for r in steps))]
    assert sum(sizes[i] for i in kept) <= bytes_
    assert select.select_extend(sized, scans, accesses, weights, 0).count() == 0
    admin = select.select_auto_admin(sized, scans, accesses, weights, 2).orderBy("step").collect()
    assert len(admin) == 2 and admin[0]["cost"] >= admin[1]["cost"] and admin[0]["score"] >= admin[1]["score"]
    dropped = select.select_drop(sized, scans, accesses, weights, 3, 5).collect()
    assert len(dropped) == 2 and all(r["score"] >= 0 for r in dropped)
    seeds = select.select_anytime(sized, scans, accesses, weights, bytes_, 2, 1).collect()
    assert len(seeds) == 3 and all(sum(sizes[i] for i in r["indexes"].split(";") if i) <= bytes_ for r in seeds)


def test_drift_properties(spark, sf_dir):
    w = drift.drift_workloads(drift.classes_of(spark, sf_dir), 20, 5, 10, True)
    rows = w.collect()
    assert all(n == 5 for n in np.unique([r["workload_id"] for r in rows], return_counts=True)[1])
    assert len({(r["workload_id"], r["class_id"]) for r in rows}) == len(rows)
    splits = drift.workload_splits(w, 5, 5).collect()
    assert len({r["workload_id"] for r in splits}) == len(splits)
    typed = querylog.typed(spark, sf_dir).where("query_id < 40")
    varied = drift.perturb_all(typed, adapters.catalog(spark, sf_dir), drift.value_pool(profile.star_counts(spark, sf_dir)), 1, 3)
    kinds = {(r["query_id"], r["ord"], r["pos"]): r["type"] for r in typed.collect()}
    for r in varied.collect():
        if r["token"] != r["original"]:
            assert not kinds[r["query_id"], r["ord"], r["pos"]].startswith("#") and r["ord"] != 1
    one = drift.value_variants(spark, sf_dir).where("query_id < 20")
    assert sorted(map(tuple, one.repartition(1).collect())) == sorted(map(tuple, one.repartition(7).collect()))
    chains = drift.similar_workloads(drift.classes_of(spark, sf_dir), 2, 4, 5).collect()
    for c in (0, 1):
        sets = [{r["class_id"] for r in chains if r["chain"] == c and r["step"] == s} for s in range(4)]
        assert all(len(a & b) == 4 for a, b in zip(sets, sets[1:]))
