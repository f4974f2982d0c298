"""What the operators of this folder share: reading, cutting lineage, ranks without a hot window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local one serves a local session; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: The tables of each scratch() that is open, the innermost last.
OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("OPEN", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that materialize() wrote in it, but those that it kept. No frame that reads them may be used later."""
    mine: list[str] = []
    token = OPEN.set((*OPEN.get(), mine))
    try:
        yield
    finally:
        OPEN.reset(token)
        for name in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs a re-read only.

    In a scratch() the table goes with it; with keep it goes with the next outer one, if there is one.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for tables in OPEN.get()[: -1 if keep else None][-1:]:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_function(kind: str):
    """Makes a function over Arrow arrays a function over columns; its type is read when a session is there."""

    def wrap(f):
        return lambda *columns: F.arrow_udf(f, kind)(*columns)

    return wrap


#: Rows that a task's Python works on at a time where what it makes of a text is large.
SLICE = 256


def slices(batches):
    """The record batches in parts of SLICE rows; so what is made of long texts is handed on before more is made."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def keyed_fraction(key: Column, share: Column) -> Column:
    """True for about that share of the keys, the same keys each time."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000


def never_null(c: Column) -> Column:
    """As text that is null for no value, and different for different ones; so plain equality joins nulls too, and keeps a partitioning."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def running_total(df: DataFrame, group: list[str], chunk: Column, order: list, totals: dict[str, str]) -> DataFrame:
    """Adds, for each item (out, value) of totals, out: the sum of value over the rows before this one in its group, in the order (chunk, order).

    chunk must not fall as order rises. A window sees one chunk's rows only; the chunks' own sums
    make the offsets, so no task holds a whole group, and df's rows are shuffled once.
    """
    keys = [f"__total_{i}" for i in range(len(group) + 1)]
    parts = df.withColumn("__total_chunk", chunk)
    parts = parts.withColumns({k: never_null(F.col(c)) for k, c in zip(keys, [*group, "__total_chunk"])})
    sums = parts.groupBy(*keys, "__total_chunk").agg(*[F.sum(v).alias(f"__total_of_{out}") for out, v in totals.items()])
    before = Window.partitionBy(*keys[:-1]).orderBy("__total_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *[F.coalesce(F.sum(f"__total_of_{out}").over(before), F.lit(0)).alias(f"__total_to_{out}") for out in totals])
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = parts.withColumns({out: F.coalesce(F.sum(v).over(inner), F.lit(0)) for out, v in totals.items()})
    joined = added.join(offsets, keys)
    return joined.withColumns({out: F.col(out) + F.col(f"__total_to_{out}") for out in totals}).drop("__total_chunk", *keys, *[f"__total_to_{out}" for out in totals])


#: Words of 64 bits of a filter of keys; it is broadcast, and no larger than this for any number of keys.
WORDS = 1 << 18
#: Columns of the filter, which no input has.
AT, WORD, FILLED = "__filter_at", "__filter_word", "__filter_bits"


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """rows with the column flag: true where the key is in keys (one column), and for few others; so only these need a join, and the rest no shuffle."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit("filter")), F.lit(64 * WORDS))
    word, bit = F.shiftright(AT, 6), (F.col(AT) % 64).cast("int")
    places = keys.toDF(key).select(place.alias(AT)).select(word.alias(WORD), bit.alias(AT))
    words = places.groupBy(WORD).agg(F.bit_or(F.expr(f"shiftleft(1L, {AT})")).alias(FILLED))  # WORDS rows at the most
    met = rows.withColumn(AT, place).withColumn(WORD, word).join(F.broadcast(words), WORD, "left")
    return met.withColumn(flag, F.coalesce(F.getbit(FILLED, bit) == 1, F.lit(False))).drop(AT, WORD, FILLED)


#: A key is hot if more than one row in HOT has it; so there are fewer than HOT of them, and they may be broadcast.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """The inner join on key. right has each key once; its column rows says how often left has it, and is dropped.

    Hot keys meet in a broadcast join of fewer than HOT rows, so no task gets more than 1/HOT of left for one key.
    right is read several times, so it should be written. No key comes to the driver or into the plan.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot, rest = right.where(F.col(rows) * HOT > total).drop(rows), right.where(F.col(rows) * HOT <= total).drop(rows)
    if not hot.limit(1).count():
        return left.join(rest, key)
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).union(others.join(rest, key))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
