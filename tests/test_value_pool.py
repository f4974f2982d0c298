"""Literals are drawn from every value of their column, by exact ranks, and no task orders a whole column."""

import duckdb
import pytest
from pyspark.sql import functions as F

from planwise.operators import drift
from planwise.sources import adapters


@pytest.fixture(scope="module")
def counts(spark):
    """Two columns of 5,000 and 300 values; most counts are shared by many."""
    rows = [("l_quantity", str(v), 1 + (v % 997 == 0) * v) for v in range(5000)] + [("l_tax", f"v{v}", v % 3) for v in range(300)] + [("l_tax", None, 9)]
    return spark.createDataFrame(rows, "col string, val string, n long")


def ranked(counts):
    found = {}
    for r in sorted((r for r in counts.collect() if r["val"] is not None), key=lambda r: (-r["n"], r["val"])):
        found.setdefault(r["col"], []).append(r["val"])
    return found


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_the_pool_holds_every_value_by_rank(counts, parts):
    want = ranked(counts)
    assert sorted(map(tuple, drift.value_pool(counts, parts).collect())) == sorted((c, i, v, len(of)) for c, of in want.items() for i, v in enumerate(of))
    assert {r["col"]: r["size"] for r in drift.value_sizes(counts).collect()} == {c: len(of) for c, of in want.items()}


def test_windows_see_chunks(counts):
    plan = drift.value_pool(counts)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert sorts and all("[col#" in s.split("AS _at")[1] and "_part#" in s.split("AS _at")[1].split("], [")[1] for s in sorts)


def tokens_of(spark, n):
    rows = [(q, "where", 2, p, t, k) for q in range(n) for p, (t, k) in enumerate([("l_quantity", "lineitem#column"), ("<", "operator"), ("7", "l_quantity#value")])]
    return spark.createDataFrame(rows, "query_id long, clause string, ord int, pos int, token string, type string")


def test_values_are_drawn_by_rank_from_the_whole_column(spark, counts):
    of = ranked(counts)["l_quantity"]
    tokens = tokens_of(spark, 300)
    got = {(r["query_id"], r["variant"]): r["token"] for r in drift.perturb_values(tokens, drift.value_pool(counts), drift.value_sizes(counts), 3).where("pos = 2").collect()}
    assert got == {(q, v): of[drift.keyed_number(q, v, 2, 2) % len(of)] for q in range(300) for v in (1, 2, 3)}
    assert sum(v in of[100:] for v in got.values()) > len(got) // 2
    rest = drift.perturb_values(tokens, drift.value_pool(counts), drift.value_sizes(counts), 1).where("pos < 2")
    assert rest.where("token <> original").count() == 0 and rest.count() == 600


def test_all_kinds_of_change_draw_from_the_whole_column(spark, counts):
    catalog = spark.createDataFrame([("lineitem", "l_quantity", "double precision"), ("lineitem", "l_tax", "double precision")], "tab string, col string, type string")
    tokens, want = tokens_of(spark, 300), ranked(counts)
    assert drift.columns_reached(tokens, catalog) == {"l_quantity", "l_tax"}
    rows = drift.perturb_all(tokens, catalog, drift.value_pool(counts), 1, 3).collect()
    by = {(r["query_id"], r["pos"]): r["token"] for r in rows}
    assert len(rows) == 900 and all(by[q, 2] == (of := want[by[q, 0]])[drift.keyed_number(q, 1, 2, 2) % len(of)] for q in range(300))
    assert {by[q, 0] for q in range(300)} == set(want) and sum(by[q, 2] in want[by[q, 0]][100:] for q in range(300)) > 150


def test_a_literal_drawn_again_is_no_edit(spark):
    """Its column holds the literal only, so the one edit allowed is left for the operator after it."""
    rows = [(q, "where", 2, p, t, k) for q in range(40) for p, (t, k) in enumerate([("l_quantity", "lineitem#column"), ("7", "l_quantity#value"), ("<", "operator")])]
    tokens = spark.createDataFrame(rows, "query_id long, clause string, ord int, pos int, token string, type string")
    catalog = spark.createDataFrame([("lineitem", "l_quantity", "double precision")], "tab string, col string, type string")
    pool = drift.value_pool(spark.createDataFrame([("l_quantity", "7", 1)], "col string, val string, n long"))
    found = drift.perturb_all(tokens, catalog, pool, 1, 1).collect()
    assert {r["token"] for r in found if r["pos"] == 1} == {"7"} and len({r["token"] for r in found if r["pos"] == 2}) > 1


def test_draws_reach_beyond_the_keys_and_are_alike_everywhere(spark):
    size = 3 * drift.KEYS + 5
    rows = spark.range(2000).select("id", F.lit(size).cast("long").alias("size"))
    got = [r[0] for r in rows.orderBy("id").select(drift.drawn(F.col("size"), F.col("id"), F.lit(1), F.lit(2))).collect()]
    assert got == [(drift.keyed_number(q, 1, 2) + drift.KEYS * (drift.keyed_number(2, 1, q) % 4)) % size for q in range(2000)]
    assert [r[0] for r in duckdb.sql(f"select {drift.drawn_sql(f'{size}::bigint', 'id', '1', '2')} from range(2000) t(id) order by id").fetchall()] == got
    assert max(got) > 2 * drift.KEYS and min(got) < drift.KEYS
    small = [r[0] for r in rows.orderBy("id").select(drift.drawn(F.lit(100), F.col("id"), F.lit(1))).collect()]
    assert small == [drift.keyed_number(q, 1) % 100 for q in range(2000)]


def test_reached_columns_are_those_of_the_last_column_before(spark, sf_dir):
    from planwise.operators import querylog

    reached = drift.columns_reached(querylog.typed(spark, sf_dir), adapters.catalog(spark, sf_dir))
    assert {"l_quantity", "l_tax", "o_custkey", "o_orderkey"} <= reached and not reached & {"c_name", "p_name"}
