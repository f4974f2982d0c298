"""Profiles and quantiles that work on distinct values and counts, not on a row a cell or all values in one task."""

import random

import duckdb

from planwise.operators import models, profile


def test_values_count_as_they_are(spark):
    """SQL counts distinct values, not their texts of four decimals; the texts' counts are summed."""
    rows = spark.createDataFrame([(1, 0.00001, "a"), (2, 0.00002, "a"), (None, None, None), (2, -0.0, "b"), (2, 0.0, "")], "i long, d double, s string")
    kinds = {"i": "bigint", "d": "double precision", "s": "character varying"}
    found = {r["col"]: (r["rows"], r["nulls"], r["ndv"]) for r in profile.distinct_stats(rows, kinds).collect()}
    assert found == {"i": (5, 1, 2), "d": (5, 1, 3), "s": (5, 1, 3)}
    counts = {(r["col"], r["val"]): r["n"] for r in profile.value_counts(rows, kinds).collect()}
    assert counts[("d", "0.0000")] == 4 and counts[("i", "2.0000")] == 3 and counts[("s", "a")] == 2 and counts[("s", None)] == 1
    assert len(counts) == 9 and {(r["rows"], r["ndv"]) for r in profile.distinct_stats(rows.limit(0), kinds).collect()} == {(0, 0)}


def test_no_row_a_cell(spark):
    """Columns are counted by themselves: nothing is exploded, so a task's memory does not grow with the number of columns."""
    rows = spark.createDataFrame([(1, 2.0)], "i long, d double")
    for df in (profile.distinct_stats(rows, {"i": "bigint", "d": "double precision"}), profile.value_counts(rows, {"i": "bigint", "d": "double precision"})):
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_are_exact(spark):
    draw = random.Random(7)
    for n in (1, 2, 3, 1000):
        pairs = [(float(draw.choice((1, 3, draw.uniform(1, 1e6)))), float(draw.choice((1, 2, draw.uniform(1, 1e6))))) for _ in range(n)]
        rows = spark.createDataFrame(pairs, "truth double, pred double").repartition(3)
        found = models.q_error_summary(rows)
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
        values = ", ".join(f"({max((p + 1e-8) / (t + 1e-8), (t + 1e-8) / (p + 1e-8))!r}::double)" for t, p in pairs)
        want = duckdb.sql("select round(avg(q), 4), " + ", ".join(f"round(quantile_cont(q, {s}), 4)" for s in (0.5, 0.9, 0.95, 0.99)) + f", round(max(q), 4) from (values {values}) v(q)").fetchall()[0]
        assert tuple(found.first()) == want
    assert tuple(models.q_error_summary(rows.limit(0)).first()) == (None,) * 6
