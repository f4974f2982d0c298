"""The values that literals are drawn from: a column's most frequent by a bounded choice, only of columns that literals belong to."""

from planwise.operators import drift, profile


def test_top_values_are_never_sorted_whole(spark):
    rows = spark.createDataFrame([(v % 7, float(v % 5), None if v % 2 else "x") for v in range(100)], "i long, d double, s string")
    kinds = {"i": "bigint", "d": "double precision", "s": "character varying"}
    found = profile.top_counts(rows, kinds, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 3 and "Window" not in plan
    want = {}
    for r in sorted(profile.value_counts(rows, kinds).where("val is not null").collect(), key=lambda r: (-r["n"], r["val"])):
        want.setdefault(r["col"], []).append((r["val"], r["n"]))
    assert sorted(map(tuple, found.collect())) == sorted((c, *v) for c, vs in want.items() for v in vs[:3])


def test_only_columns_with_literals_are_counted(spark):
    tokens = spark.createDataFrame([("o_custkey#value",), ("l_quantity#value",), ("#value",), ("c_name#column",), ("nosuch#value",)], "type string")
    assert drift.columns_drawn_from(tokens) == {"o_custkey", "l_quantity"}
    tops = profile.star_tops(spark, "/root/testdata/sf0.001", 5, {"o_custkey", "l_quantity"})
    assert {r["col"]: r["count"] for r in tops.groupBy("col").count().collect()} == {"o_custkey": 5, "l_quantity": 5}
    assert profile.star_tops(spark, "/root/testdata/sf0.001", 5, set()).count() == 0
