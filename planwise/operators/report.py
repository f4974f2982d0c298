"""Reports over tidy measures (component, batch, name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from ..sources.adapters import read


def total_measure(measures: DataFrame, reps: int = 1) -> DataFrame:
    return measures.groupBy("component", "name").agg(F.round(F.sum("value") / reps, 4).alias("total"), F.round(F.avg("value"), 4).alias("average"))


@query("sum_measure", "select component, name, round(sum(value) / 2, 4) as total from measures group by component, name")
def _(spark, sf_dir):
    return total_measure(adapters.measures(spark, sf_dir), 2).select("component", "name", "total")


@query("avg_measure", "select component, name, round(avg(value), 4) as average from measures group by component, name")
def _(spark, sf_dir):
    return total_measure(adapters.measures(spark, sf_dir)).select("component", "name", "average")


def comparison_table(measures: DataFrame) -> DataFrame:
    """component, rounds, recommendation (what of the total is neither creation nor execution), creation, execution, total."""
    part = lambda n: F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0))
    return measures.groupBy("component").agg(
        F.countDistinct("batch").alias("rounds"), F.round(part("total") - part("creation") - part("execution"), 4).alias("recommendation"), F.round(part("creation"), 4).alias("creation"), F.round(part("execution"), 4).alias("execution"), F.round(part("total"), 4).alias("total")
    )


@query(
    "comparison_table",
    "select component, count(distinct batch) as rounds, round(t - c - e, 4) as recommendation, round(c, 4) as creation, round(e, 4) as execution, round(t, 4) as total from (select component, batch, sum(value) filter (name = 'total') over p as t, sum(value) filter (name = 'creation') over p as c, sum(value) filter (name = 'execution') over p as e from measures window p as (partition by component)) group by component, t, c, e",
)
def _(spark, sf_dir):
    return comparison_table(adapters.measures(spark, sf_dir))


def measure_pivot(measures: DataFrame, batches: list[int] | None = None) -> DataFrame:
    """name, a column of means for each batch (0 where none), and their sum. batches: all that occur, in order, where not given; Spark raises beyond spark.sql.pivotMaxValues."""
    keyed = measures.groupBy("name")
    wide = (keyed.pivot("batch", batches) if batches else keyed.pivot("batch")).agg(F.avg("value"))
    cells = [F.round(F.coalesce(F.col(f"`{b}`"), F.lit(0.0)), 6).alias(f"b{b}") for b in wide.columns if b != "name"]
    rows = wide.select("name", *cells)
    return rows.withColumn("total", F.round(sum((F.col(f"`{c}`") for c in rows.columns if c != "name"), F.lit(0.0)), 6))


@query(
    "measure_pivot",
    """
select name, list(cell order by batch) as cells, round(sum(cell), 6) as total from (
  select n.name, b.batch, round(coalesce(m.mean, 0), 6) as cell from (select distinct name from measures) n cross join (select distinct batch from measures) b
  left join (select name, batch, avg(value) as mean from measures group by name, batch) m on m.name = n.name and m.batch = b.batch) group by name""",
)
def _(spark, sf_dir):
    """The pivot of all batches, its cells as one list."""
    wide = measure_pivot(adapters.measures(spark, sf_dir))
    return wide.select("name", F.array(*[F.col(c) for c in wide.columns if c not in ("name", "total")]).alias("cells"), "total")


@query("measure_cube", "select component, batch, name, round(sum(value), 4) as total, count(*) as n from measures group by cube (component, batch, name)")
def _(spark, sf_dir):
    return adapters.measures(spark, sf_dir).cube("component", "batch", "name").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("measure_rollup", "select component, batch, round(sum(value), 4) as total from measures group by rollup (component, batch)")
def _(spark, sf_dir):
    return adapters.measures(spark, sf_dir).rollup("component", "batch").agg(F.round(F.sum("value"), 4).alias("total"))


def daily(spark, sf_dir) -> DataFrame:
    """component, batch, value: the mean of each day."""
    return adapters.measures(spark, sf_dir).groupBy("component", "batch").agg(F.avg("value").alias("value"))


DAILY = "(select component, batch, avg(value) as value from measures group by component, batch)"


def running_average(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.round(F.avg(value).over(w), 4))


@query("running_average", f"select component, batch, round(avg(value) over (partition by component order by batch rows unbounded preceding), 4) as running from {DAILY}")
def _(spark, sf_dir):
    return running_average(daily(spark, sf_dir), "component", "batch", "value").select("component", "batch", "running")


def moving_average(rows: DataFrame, key: str, order: str, value: str, half: int) -> DataFrame:
    """Centred; beyond the ends there are zeros, so the window's size always divides."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)
    return rows.withColumn("moving", F.round(F.sum(value).over(w) / (2 * half + 1), 4))


@query("moving_average", f"select component, batch, round(sum(value) over (partition by component order by batch rows between 2 preceding and 2 following) / 5, 4) as moving from {DAILY}")
def _(spark, sf_dir):
    return moving_average(daily(spark, sf_dir), "component", "batch", "value", 2).select("component", "batch", "moving")


def normalize_by_history(rows: DataFrame, key: str, order: str, value: str, low: float, high: float, few: int = 5) -> DataFrame:
    """(v - min) / (max - min) over the values so far: up to few of them by assumed bounds, beyond by the least less one."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n, a, b = F.count(value).over(w), F.min(value).over(w) - 1, F.max(value).over(w)
    scaled = F.when(n <= few, (F.col(value) - low) / (high - low)).otherwise((F.col(value) - a) / (b - a))
    return rows.withColumn("normalized", F.round(scaled, 6))


@query(
    "normalize_by_history",
    f"select component, batch, round(case when count(value) over w <= 5 then value / 100 else (value - min(value) over w + 1) / (max(value) over w - min(value) over w + 1) end, 6) as normalized from {DAILY} window w as (partition by component order by batch rows unbounded preceding)",
)
def _(spark, sf_dir):
    return normalize_by_history(daily(spark, sf_dir), "component", "batch", "value", 0.0, 100.0).select("component", "batch", "normalized")


@query("index_utility", f"select component, batch, round(1 - value / first_value(value) over (partition by component order by batch), 6) as utility from {DAILY}")
def _(spark, sf_dir):
    """1 - cost / cost of the round without indexes, here each component's first."""
    first = F.first("value").over(Window.partitionBy("component").orderBy("batch"))
    return daily(spark, sf_dir).select("component", "batch", F.round(1 - F.col("value") / first, 6).alias("utility"))


def mean_performance(rows: DataFrame, keys: list[str], initial: Column, current: Column) -> DataFrame:
    """Means of the achieved cost, current / initial * 100 rounded to 2, by all prefixes of keys."""
    return rows.withColumn("_a", F.round(current / initial * 100, 2)).rollup(*keys).agg(F.round(F.avg("_a"), 4).alias("mean"), F.count("*").alias("n"))


@query("mean_performance", f"select component, share, round(avg(a), 4) as mean, count(*) as n from (select component, batch % 3 as share, round(value / first * 100, 2) as a from (select *, max(value) over (partition by component) as first from {DAILY})) group by rollup (component, share)")
def _(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("first", F.max("value").over(Window.partitionBy("component"))).withColumn("share", F.col("batch") % 3)
    return mean_performance(rows, ["component", "share"], F.col("first"), F.col("value"))


@query("latest_cost", f"select component, batch, value as latest from {DAILY} qualify row_number() over (partition by component order by batch desc) = 1".replace("value as latest", "round(value, 4) as latest"))
def _(spark, sf_dir):
    """As of now: the cost of each component's latest round."""
    return daily(spark, sf_dir).groupBy("component").agg(F.max("batch").alias("batch"), F.round(F.max_by("value", "batch"), 4).alias("latest"))


@query("unindexable_columns", "select tab, col from (select distinct tab, col from query_column) anti join (select distinct tab, col from literals) using (tab, col)")
def _(spark, sf_dir):
    """Touched columns that no candidate would cover for want of a predicate."""
    from .cost import literals_of
    from .querylog import columns_of

    return columns_of(spark, sf_dir).select("tab", "col").distinct().join(literals_of(spark, sf_dir), ["tab", "col"], "left_anti")


@query("price_extremes", "select o_orderpriority, max(o_totalprice) as dearest, min(o_totalprice) as cheapest, count(*) as orders from orders group by o_orderpriority")
def _(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("dearest"), F.min("o_totalprice").alias("cheapest"), F.count("*").alias("orders"))
