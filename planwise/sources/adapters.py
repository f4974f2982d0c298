"""The library's input frames, derived from the star schema and the event stream by plain expressions.

One event is one execution of a query: its id picks a template, its property the literal.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that queries are about, with the columns' types as a catalog names them.
TABLES = {
    "region": {"r_regionkey": "integer", "r_name": "character varying"},
    "nation": {"n_nationkey": "integer", "n_name": "character varying", "n_regionkey": "integer"},
    "customer": {"c_custkey": "bigint", "c_name": "character varying", "c_nationkey": "integer", "c_acctbal": "double precision", "c_mktsegment": "character varying"},
    "supplier": {"s_suppkey": "bigint", "s_name": "character varying", "s_nationkey": "integer", "s_acctbal": "double precision"},
    "part": {"p_partkey": "bigint", "p_name": "character varying", "p_brand": "character varying", "p_type": "character varying", "p_size": "integer", "p_retailprice": "double precision"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "character varying", "o_totalprice": "double precision", "o_orderdate": "timestamp without time zone", "o_orderpriority": "character varying"},
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer", "l_quantity": "double precision", "l_extendedprice": "double precision", "l_discount": "double precision",
        "l_tax": "double precision", "l_returnflag": "character varying", "l_linestatus": "character varying", "l_shipdate": "timestamp without time zone",
    },
}

#: Type names of a catalog by Spark's.
CATALOG_TYPE = {"int": "integer", "bigint": "bigint", "double": "double precision", "string": "character varying", "timestamp": "timestamp without time zone", "timestamp_ntz": "timestamp without time zone", "date": "date", "float": "real", "boolean": "boolean"}

#: Flat statements of every clause shape; {k} is the event's literal.
TEMPLATES = [
    "select c_name from customer where c_custkey = {k}",
    "select o_orderkey , o_totalprice from orders where o_custkey = {k} order by o_orderdate",
    "select sum ( l_extendedprice ) from lineitem where l_quantity < {k}",
    "select l_returnflag , sum ( l_quantity ) from lineitem where l_extendedprice > {k}000 group by l_returnflag",
    "select o_orderpriority , count ( o_orderkey ) from orders where o_totalprice > {k}000 group by o_orderpriority order by o_orderpriority",
    "select c_mktsegment , avg ( c_acctbal ) from customer group by c_mktsegment having avg ( c_acctbal ) > {k}",
    "select c_name , o_orderdate from customer join orders on c_custkey = o_custkey where o_totalprice > {k}000",
    "select n_name , sum ( s_acctbal ) from supplier join nation on s_nationkey = n_nationkey where s_acctbal > {k} group by n_name having sum ( s_acctbal ) > {k}00 order by n_name",
    "select p_name from part where p_size = {k} and p_retailprice > {k}0 order by p_name",
    "select l_shipdate , l_quantity from lineitem where l_orderkey = {k} and l_linenumber > 1",
    "select p_brand , count ( p_partkey ) from part group by p_brand order by p_brand",
    "select max ( o_totalprice ) from orders",
    "select l_partkey , count ( l_orderkey ) from lineitem join part on l_partkey = p_partkey where p_size < {k} group by l_partkey having count ( l_orderkey ) > {k}",
    "select s_name from supplier order by s_acctbal",
    "select c_nationkey , min ( c_acctbal ) from customer group by c_nationkey having min ( c_acctbal ) < {k} order by c_nationkey",
    "select o_orderdate , l_shipdate from orders join lineitem on o_orderkey = l_orderkey where l_quantity > {k} or l_discount != 0.0{k} order by o_orderdate",
    "select p_type from part group by p_type",
    "select l_suppkey from lineitem where l_shipdate > {k} and l_quantity = {k}",
]


_DERIVED: dict[tuple, DataFrame] = {}


def derived(build):
    """A frame of (spark, sf_dir) that several queries start from: built once an application and kept, on disk where memory is short.

    Such frames are a row a distinct text, plan node, candidate or column, far fewer than the log's rows.
    """

    @wraps(build)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, f"{build.__module__}.{build.__name__}", sf_dir)
        if key not in _DERIVED:
            _DERIVED[key] = build(spark, sf_dir).persist()
        return _DERIVED[key]

    return once


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_of(df: DataFrame, tab: str) -> DataFrame:
    """tab, col, ordinal, type, rows of one table, from its schema and a count."""
    columns = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(i + 1).alias("ordinal"), F.lit(CATALOG_TYPE.get(t, t)).alias("type")) for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(F.count("*").alias("rows")).select(F.lit(tab).alias("tab"), F.explode(columns).alias("c"), "rows").select("tab", "c.col", "c.ordinal", "c.type", "rows")


@derived
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [catalog_of(read(spark, sf_dir, t).select(*TABLES[t]), t) for t in TABLES])


def query_log(spark: SparkSession, sf_dir: str, templates: list[str] = TEMPLATES) -> DataFrame:
    """query_id, template_id, round_id, ts, sql, freq, latency, user_id."""
    events = read(spark, sf_dir, "events")
    template = (F.col("event_id") % len(templates)).cast("int")
    text = F.element_at(F.array(*map(F.lit, templates)), template + 1)
    return events.select(
        F.col("event_id").alias("query_id"), template.alias("template_id"), F.datediff("ts", F.lit("2024-01-01")).alias("round_id"), "ts",
        F.replace(text, F.lit("{k}"), F.get_json_object("props", "$.k")).alias("sql"), (1 + (F.col("event_id") * 7919) % 1000).alias("freq"), F.col("value").alias("latency"), "user_id",
    )


def workload(log: DataFrame) -> DataFrame:
    """query_id (the least), template_id, sql, freq (summed), n: each text once, so later steps touch no repeats."""
    return log.groupBy("template_id", "sql").agg(F.min("query_id").alias("query_id"), F.sum("freq").alias("freq"), F.count("*").alias("n")).select("query_id", "template_id", "sql", "freq", "n")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component, batch, name, value: the event type is a component, its user parity a measure's name, the day a batch."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("component"), F.datediff("ts", F.lit("2024-01-01")).alias("batch"), F.element_at(F.array(F.lit("execution"), F.lit("creation"), F.lit("total")), (F.col("user_id") % 3 + 1).cast("int")).alias("name"), "value"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, truth, pred, both positive: an order's price, and what its lines come to."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("truth"))
    return orders.join(lines, F.col("id") == F.col("l_orderkey")).where("truth > 0 and pred > 0").select("id", "truth", F.round("pred", 4).alias("pred"))
