"""Files of a workload study: workloads, catalogs, delimited tables, cost logs; and results written out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from . import adapters

CATALOG_SCHEMA = "table string, rows long, columns array<struct<name: string, type: string>>"
#: Neighbouring query ids that share a file of a workload written as JSON.
IDS_A_FILE = 10_000
COST_SCHEMA = "sql string, indexes array<string>, est_without double, est_with double, act_without double, act_with double, plan_without string, plan_with string"


def read_workload(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """query_id, sql, freq. kind `sql`: one statement a line, numbered by hash-free place in its file; `json`: rows [id, "sql", freq], or texts alone."""
    if kind == "sql":
        lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), F.posexplode(F.split("value", "\n")).alias("_i", "sql"))
        return lines.where("trim(sql) != ''").select(F.col("_i").cast("long").alias("query_id"), F.trim("sql").alias("sql"), F.lit(None).cast("long").alias("freq"))
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("_i", "_item"))  # an item of any form, as its JSON text
    row = F.from_json("_item", "array<string>")
    named = F.get_json_object("_item", "$.sql")
    return items.select(
        F.coalesce(F.try_element_at(row, F.lit(1)).try_cast("long"), F.col("_i").cast("long")).alias("query_id"), F.coalesce(F.try_element_at(row, F.lit(2)), named, F.col("_item")).alias("sql"), F.try_element_at(row, F.lit(-1)).try_cast("long").alias("freq")
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """tab, col, ordinal, type, rows of a catalog file: an array of tables, or one a line."""
    raw = spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=True)
    return raw.select(F.col("table").alias("tab"), "rows", F.posexplode("columns").alias("_i", "_c")).select("tab", F.col("_c.name").alias("col"), (F.col("_i") + 1).alias("ordinal"), F.col("_c.type").alias("type"), "rows")


def load_delimited(spark: SparkSession, path: str, schema, sep: str = "|") -> DataFrame:
    """Empty strings are nulls; the schema is given, so the file is read once."""
    return spark.read.csv(path, schema=schema, sep=sep, nullValue="", emptyValue="")


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """Cost records; fold and split come from the folders' names (fold=src/split=train)."""
    return spark.read.schema(f"{COST_SCHEMA}, fold string, split string").json(path)


def write_result(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def json_item() -> Column:
    """A query of the workload as an item that read_workload takes."""
    return F.concat(F.lit("["), F.col("query_id"), F.lit(', "'), "sql", F.lit('", '), F.col("freq"), F.lit("]"))


@query("workload_as_json", "select query_id, '[' || query_id || ', \"' || sql || '\", ' || freq || ']' as item from workload")
def _(spark, sf_dir):
    """Each query in the form that read_workload takes."""
    from ..operators.querylog import prepared

    return prepared(spark, sf_dir).select("query_id", json_item().alias("item"))


@query("catalog_as_json", "select tab, count(*) as columns, max(rows) as rows, string_agg(col, ',' order by ordinal) as names from catalog group by tab")
def _(spark, sf_dir):
    """A catalog through its nested form and back."""
    nested = adapters.catalog(spark, sf_dir).groupBy("tab").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("ordinal", F.col("col").alias("name"), "type"))).alias("columns"))
    text = nested.select(F.to_json(F.struct(F.col("tab").alias("table"), "rows", "columns")).alias("j"))
    back = text.select(F.from_json("j", CATALOG_SCHEMA).alias("t")).select("t.*")
    return back.select(F.col("table").alias("tab"), F.size("columns").cast("long").alias("columns"), "rows", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the folder that the cluster names in spark.checkpoint.dir; a local session without one gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("read_workload", "select query_id, sql, freq from workload")
def _(spark, sf_dir):
    """The workload from JSON files of at most IDS_A_FILE queries each."""
    from ..operators.querylog import prepared

    items = F.array_join(F.collect_list(json_item()), ", ")
    grouped = prepared(spark, sf_dir).groupBy(F.floor(F.col("query_id") / IDS_A_FILE)).agg(F.concat(F.lit("["), items, F.lit("]")).alias("value"))
    path = new_folder(spark, "workload")
    grouped.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_workload(spark, path, "json")


@query("read_catalog", "select tab, col, ordinal, type, rows from catalog")
def _(spark, sf_dir):
    """The catalog from a JSON file a table."""
    column = F.struct("ordinal", F.col("col").alias("name"), "type")
    nested = adapters.catalog(spark, sf_dir).groupBy(F.col("tab").alias("table")).agg(F.max("rows").alias("rows"), F.array_sort(F.collect_list(column)).alias("columns"))
    path = new_folder(spark, "catalog")
    nested.write.option("maxRecordsPerFile", 1).json(path)
    return read_catalog(spark, path)


@query("load_delimited", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _(spark, sf_dir):
    """Orders from text with bars between the fields."""
    orders = adapters.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = new_folder(spark, "delimited")
    orders.write.csv(path, sep="|", nullValue="", emptyValue="")
    return load_delimited(spark, path, orders.schema)


@query("read_cost_log", "select sql, index_id, without as est_without, with_cost as est_with, case when query_id % 5 = 0 then 'valid' else 'train' end as split from single_cost join workload using (query_id)")
def _(spark, sf_dir):
    """Each query's cost without and with each index, from JSON in folders by fold and split."""
    from ..operators.cost import singles_of
    from ..operators.querylog import prepared

    costs = singles_of(spark, sf_dir).select("query_id", "index_id", "without", "with_cost").join(prepared(spark, sf_dir).select("query_id", "sql"), "query_id")
    split = F.when(F.col("query_id") % 5 == 0, "valid").otherwise("train")
    record = costs.select("sql", F.array("index_id").alias("indexes"), F.col("without").alias("est_without"), F.col("with_cost").alias("est_with"), F.lit("src").alias("fold"), split.alias("split"))
    path = new_folder(spark, "costs")
    write_result(record, path, "json", ["fold", "split"])
    return read_cost_log(spark, path).select("sql", F.element_at("indexes", 1).alias("index_id"), "est_without", "est_with", "split")


@query("write_result", "select component, batch, name, value from measures")
def _(spark, sf_dir):
    """Measures as Parquet in a folder a component, read again."""
    measures = adapters.measures(spark, sf_dir)
    path = new_folder(spark, "measures")
    write_result(measures, path, by=["component"])
    return spark.read.schema(measures.schema).parquet(path).select("component", "batch", "name", "value")
