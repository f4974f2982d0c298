"""Table and column profiles: counts, nulls, distinct values, extremes, widths, histograms, selectivities, vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..registry import query
from ..sources import adapters
from ..sources.adapters import TABLES, derived, read
from ..sources.twins import frame, quoted

NUMERIC = {"integer", "bigint", "double precision", "numeric", "real", "smallint"}


def as_text(c: Column, kind: str) -> Column:
    """A value's text, alike in every engine: numbers with four decimals, times to the second."""
    if kind in NUMERIC:
        return c.cast("decimal(24,4)").cast("string")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c.cast("string")


#: Types whose distinct values have distinct texts.
ONE_TEXT_EACH = ("integer", "bigint", "smallint", "date", "boolean")


def counted(df: DataFrame, c: str) -> DataFrame:
    """val, n: a column's values as they are, each once. The scan reads this column alone, and what repeats is summed before the shuffle."""
    return df.groupBy(F.col(c).alias("val")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """col, val, n: values as text. Only distinct values are written as text, and only those of types where two may share one are summed again."""

    def of(c: str, kind: str) -> DataFrame:
        texts = counted(df, c).select(F.lit(c).alias("col"), as_text(F.col("val"), kind).alias("val"), "n")
        return texts if kind in ONE_TEXT_EACH or kind.startswith("character") else texts.groupBy("col", "val").agg(F.sum("n").alias("n"))

    return reduce(DataFrame.unionByName, [of(c, k) for c, k in kinds.items()])


def distinct_stats(df: DataFrame, kinds: dict[str, str], approximate: bool = False) -> DataFrame:
    """col, rows, nulls, ndv. approximate: by sketches, one pass without a shuffle of values."""
    if approximate:
        aggs = [f(c) for c in kinds for f in (lambda c: F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}"), lambda c: F.approx_count_distinct(c).alias(f"d_{c}"))]
        one = df.agg(F.count("*").alias("rows"), *aggs)
        rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("ndv")) for c in kinds])
        return one.select("rows", F.explode(rows).alias("_s")).select("_s.col", "rows", "_s.nulls", "_s.ndv")
    each = [
        counted(df, c).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("val").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("val").alias("ndv")).select(F.lit(c).alias("col"), "rows", "nulls", "ndv")
        for c in kinds
    ]
    return reduce(DataFrame.unionByName, each)


def extremes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """col, min_val, max_val, lo, hi (numbers; null for others), width (mean bytes): one aggregate, no shuffle of rows."""
    fixed = {"integer": 4, "smallint": 2, "real": 4, "bigint": 8, "double precision": 8, "numeric": 8, "date": 4, "boolean": 1}
    aggs: list[Column] = []
    for c, k in kinds.items():
        width = F.avg(F.octet_length(F.col(c))) if k.startswith("character") else F.lit(float(fixed.get(k, 8)))
        aggs += [F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), width.alias(f"w_{c}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("col"), as_text(F.col(f"a_{c}"), k).alias("min_val"), as_text(F.col(f"b_{c}"), k).alias("max_val"),
            (F.col(f"a_{c}").cast("double") if k in NUMERIC else F.lit(None).cast("double")).alias("lo"), (F.col(f"b_{c}").cast("double") if k in NUMERIC else F.lit(None).cast("double")).alias("hi"),
            F.round(F.col(f"w_{c}"), 4).alias("width"),
        ) for c, k in kinds.items()
    ])
    return one.select(F.explode(rows).alias("_e")).select("_e.*")


def column_stats(df: DataFrame, tab: str, kinds: dict[str, str], approximate: bool = False) -> DataFrame:
    """tab, col, rows, null_frac, dist_frac, ndv, min_val, max_val, lo, hi, width."""
    share = lambda n: F.expr(f"(({n} * 20000 + rows) div (2 * greatest(rows, 1))) / 10000.0D")  # to 4 places, halves up, in whole numbers
    both = distinct_stats(df, kinds, approximate).join(F.broadcast(extremes(df, kinds)), "col")  # a row a column
    return both.select(F.lit(tab).alias("tab"), "col", "rows", share("nulls").alias("null_frac"), share("ndv").alias("dist_frac"), "ndv", "min_val", "max_val", "lo", "hi", "width")


@derived
def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_stats(read(spark, sf_dir, t), t, k) for t, k in TABLES.items()])


def sql_text(c: str, kind: str) -> str:
    if kind in NUMERIC:
        return f"{c}::decimal(24,4)::varchar"
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind.startswith("timestamp") else c


def sql_share(n: str) -> str:
    return f"(({n} * 20000 + count(*)) // (2 * greatest(count(*), 1)))::double / 10000"


def sql_stats(tab: str, c: str, kind: str) -> str:
    fixed = {"integer": 4, "bigint": 8, "double precision": 8}
    width = f"round(avg(strlen({c})), 4)" if kind.startswith("character") else f"{fixed.get(kind, 8)}.0"
    number = kind in NUMERIC
    return (
        f"select {quoted(tab)} as tab, {quoted(c)} as col, count(*) as rows, {sql_share(f'count(*) filter ({c} is null)')} as null_frac, {sql_share(f'count(distinct {c})')} as dist_frac, count(distinct {c}) as ndv, "
        f"{sql_text(f'min({c})', kind)} as min_val, {sql_text(f'max({c})', kind)} as max_val, {f'min({c})::double' if number else 'null::double'} as lo, {f'max({c})::double' if number else 'null::double'} as hi, {width} as width from {tab}"
    )


frame("column_stats", " union all ".join(sql_stats(t, c, k) for t, columns in TABLES.items() for c, k in columns.items()))


@query("catalog_from_tables", "select * from catalog")
def _(spark, sf_dir):
    return adapters.catalog(spark, sf_dir)


@query("column_types", "select tab, col, type from catalog")
def _(spark, sf_dir):
    return adapters.catalog(spark, sf_dir).select("tab", "col", "type")


@query("row_count", " union all ".join(f"select {quoted(t)} as tab, count(*) as rows from {t}" for t in TABLES))
def _(spark, sf_dir):
    return reduce(DataFrame.unionByName, [read(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("tab"), "rows") for t in TABLES])


@query("column_stats", "select * from column_stats")
def _(spark, sf_dir):
    return all_stats(spark, sf_dir)


for _name, _columns in {"null_fraction": "null_frac", "distinct_ratio": "dist_frac", "num_uniques": "ndv", "min_values": "min_val", "max_values": "max_val", "column_width": "width"}.items():

    @query(_name, f"select tab, col, {_columns} from column_stats")
    def _(spark, sf_dir, _column=_columns):
        return all_stats(spark, sf_dir).select("tab", "col", _column)


def document_kinds(df: DataFrame) -> dict[str, str]:
    return {c: adapters.CATALOG_TYPE[t] for c, t in df.dtypes if t in adapters.CATALOG_TYPE}


@query("document_stats", " union all ".join(sql_stats("documents", c, k) for c, k in {"doc_id": "bigint", "text": "character varying", "lang": "character varying", "source": "character varying", "n_chars": "bigint"}.items()))
def _(spark, sf_dir):
    """The same profile of a table of long texts."""
    docs = read(spark, sf_dir, "documents")
    return column_stats(docs, "documents", document_kinds(docs))


def table_sizes(stats: DataFrame) -> DataFrame:
    """tab, rows, bytes, and the share of all tables' bytes."""
    sizes = stats.groupBy("tab").agg(F.max("rows").alias("rows"), (F.max("rows") * F.sum("width")).alias("bytes"))
    total = sizes.agg(F.sum("bytes").alias("_all"))
    return sizes.join(F.broadcast(total)).select("tab", "rows", F.round("bytes", 2).alias("bytes"), F.round(F.col("bytes") / F.col("_all"), 4).alias("share"))


@query("table_size", "select tab, rows, round(bytes, 2) as bytes, round(bytes / sum(bytes) over (), 4) as share from (select tab, max(rows) as rows, max(rows) * sum(width) as bytes from column_stats group by tab)")
def _(spark, sf_dir):
    return table_sizes(all_stats(spark, sf_dir))


#: Key pairs whose inclusion is measured.
KEY_PAIRS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_custkey", "orders", "o_custkey"),
]


def inclusion(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """child_keys, covered, coverage, fan_out. Keys meet once each, with their counts, so hot keys weigh nothing."""
    own = child.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(F.count("*").alias("n"))
    other = parent.select(F.col(parent_key).cast("long").alias("k")).distinct().withColumn("hit", F.lit(1))
    return own.join(other, "k", "left").agg(
        F.count("*").alias("child_keys"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 4).alias("coverage"), F.round(F.sum("n") / F.count("*"), 4).alias("fan_out")
    )


@query(
    "join_relations",
    " union all ".join(
        f"select '{ct}.{ck} -> {pt}.{pk}' as relation, count(*) as child_keys, count(hit) as covered, round(count(hit) / count(*), 4) as coverage, round(sum(n) / count(*), 4) as fan_out from (select {ck} as k, count(*) as n from {ct} where {ck} is not null group by 1) left join (select distinct {pk} as k, 1 as hit from {pt}) using (k)"
        for ct, ck, pt, pk in KEY_PAIRS
    ),
)
def _(spark, sf_dir):
    found = [inclusion(read(spark, sf_dir, ct), ck, read(spark, sf_dir, pt), pk).withColumn("relation", F.lit(f"{ct}.{ck} -> {pt}.{pk}")) for ct, ck, pt, pk in KEY_PAIRS]
    return reduce(DataFrame.unionByName, found).select("relation", "child_keys", "covered", "coverage", "fan_out")


PREDICATES = {"quantity_low": "l_quantity < 10", "discounted": "l_discount > 0.05", "returned": "l_returnflag = 'R'", "dear_and_late": "l_extendedprice > 50000 and l_shipdate >= timestamp '1997-01-01 00:00:00'", "first_line": "l_linenumber = 1"}


def selectivities(df: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """predicate, matched, selectivity: any number of predicates in one scan."""
    one = df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.expr(p), 1)).alias(n) for n, p in predicates.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("matched")) for n in predicates])
    return one.select("rows", F.explode(rows).alias("_p")).select("_p.predicate", "_p.matched", rounded(F.col("_p.matched") / F.greatest("rows", F.lit(1)), 6).alias("selectivity"))


@query("predicate_selectivity", " union all ".join(f"select '{n}' as predicate, count(*) filter ({p}) as matched, round(count(*) filter ({p}) / count(*), 6) as selectivity from lineitem" for n, p in PREDICATES.items()))
def _(spark, sf_dir):
    return selectivities(read(spark, sf_dir, "lineitem"), PREDICATES)


def equi_depth_bins(frequencies: DataFrame, bins: int) -> DataFrame:
    """col, bin (0..bins), boundary: the position where the cumulative mass first reaches bin/bins of the whole.

    frequencies: col, pos (from 0), freq. The mass of the first position is not counted, and boundary 0
    is the last of the leading positions without mass, as in the histogram this follows.
    """
    later = frequencies.where("pos > 0")
    upto = Window.partitionBy("col").orderBy("pos")
    total = later.groupBy("col").agg(F.sum("freq").alias("_total"))
    mass = later.withColumn("_cum", F.sum("freq").over(upto)).join(F.broadcast(total), "col")  # a row a column
    reached = mass.withColumn("_k", F.floor(F.col("_cum") * bins / F.col("_total") + 1e-9)).withColumn("_before", F.coalesce(F.lag("_k").over(upto), F.lit(0)))
    edges = reached.where("_k > _before").select("col", F.explode(F.sequence(F.col("_before") + 1, F.col("_k"))).alias("bin"), F.col("pos").alias("boundary"))
    first = frequencies.groupBy("col").agg((F.coalesce(F.min(F.when((F.col("freq") > 0) & (F.col("pos") > 0), F.col("pos"))), F.lit(1)) - 1).alias("boundary"))
    return edges.select("col", F.col("bin").cast("int").alias("bin"), "boundary").union(first.select("col", F.lit(0).alias("bin"), "boundary"))


def lineitem_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    pairs = F.array(F.struct(F.lit("l_quantity").alias("col"), F.col("l_quantity").cast("int").alias("pos")), F.struct(F.lit("l_discount").alias("col"), F.round(F.col("l_discount") * 100).cast("int").alias("pos")))
    return lines.select(F.explode(pairs).alias("_p")).groupBy("_p.col", "_p.pos").agg(F.count("*").alias("freq"))


def bins_sql(n: int) -> str:
    return f"""
select col, bin::int as bin, boundary from (
  select col, k.bin, min(pos) as boundary from (
    select col, pos, sum(freq) over (partition by col order by pos) as cum, sum(freq) over (partition by col) as total from frequencies where pos > 0) c
  join range(1, {n + 1}) k(bin) on floor(cum * {n} / total + 1e-9) >= k.bin group by col, k.bin
  union all select col, 0, coalesce(min(case when freq > 0 and pos > 0 then pos end), 1) - 1 from frequencies group by col)"""


frame("frequencies", "select col, pos, count(*) as freq from (select 'l_quantity' as col, l_quantity::int as pos from lineitem union all select 'l_discount', round(l_discount * 100)::int from lineitem) group by col, pos")


@query("equi_depth_bins", bins_sql(50))
def _(spark, sf_dir):
    return equi_depth_bins(lineitem_frequencies(spark, sf_dir), 50)


@query("histogram_rebin", bins_sql(10))
def _(spark, sf_dir):
    return equi_depth_bins(lineitem_frequencies(spark, sf_dir), 10)


def histogram_mask(histogram: DataFrame, predicates: DataFrame) -> DataFrame:
    """pred_id, mask: 1 for each bin that may hold rows of `col op literal`. histogram: col, bin, boundary; each predicate uses its own op and value."""
    edges = histogram.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "boundary"))), lambda e: e["boundary"]).alias("edges"))
    low, high = (lambda i: F.element_at("edges", i + 1)), (lambda i: F.element_at("edges", i + 2))
    hit = lambda i: F.when(F.col("op") == "<", low(i) < F.col("literal")).when(F.col("op") == ">", high(i) > F.col("literal")).otherwise((low(i) <= F.col("literal")) & (F.col("literal") <= high(i)))
    mask = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda i: hit(i.cast("int")).cast("int"))
    return predicates.join(edges, "col").select("pred_id", F.array_join(mask.cast("array<string>"), "").alias("mask"))


MASKED = [(1, "l_quantity", "<", 12.0), (2, "l_quantity", ">", 30.0), (3, "l_quantity", "=", 7.0), (4, "l_discount", "=", 5.0), (5, "l_discount", "<", 0.0)]


@query(
    "predicate_histogram_mask",
    f"select pred_id, string_agg(case when op = '<' then (lo < literal)::int when op = '>' then (hi > literal)::int else (lo <= literal and literal <= hi)::int end::varchar, '' order by bin) as mask from (values {', '.join(map(str, MASKED))}) p(pred_id, col, op, literal) join (select col, bin, lag(boundary) over (partition by col order by bin) as lo, boundary as hi from ({bins_sql(10)})) h using (col) where lo is not null group by pred_id",
)
def _(spark, sf_dir):
    return histogram_mask(equi_depth_bins(lineitem_frequencies(spark, sf_dir), 10), spark.createDataFrame(MASKED, "pred_id int, col string, op string, literal double"))


def sample_bitmap(df: DataFrame, key: list[str], predicates: dict[str, str], size: int = 1000) -> DataFrame:
    """predicate, bitmap over the first size rows by key (a fixed, bounded sample: the feature's definition)."""
    taken = df.orderBy(*key).limit(size)
    flags = F.array(*[F.struct(F.lit(n).alias("predicate"), F.coalesce(F.expr(p).cast("int"), F.lit(0)).alias("bit")) for n, p in predicates.items()])
    return taken.select(F.struct(*key).alias("_k"), F.explode(flags).alias("_f")).groupBy("_f.predicate").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_f.bit"))), lambda x: x["bit"].cast("string")), "").alias("bitmap")
    )


@query(
    "sample_bitmap",
    "select predicate, string_agg(bit::varchar, '' order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as bitmap from ("
    + " union all ".join(f"select '{n}' as predicate, ({p})::int as bit, l_orderkey, l_linenumber, l_partkey, l_suppkey from (select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey limit 1000)" for n, p in PREDICATES.items())
    + ") group by predicate",
)
def _(spark, sf_dir):
    return sample_bitmap(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], PREDICATES)


def minmax_normalize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as (v - min) / (max - min), 0 where all are equal. The extremes are one row."""
    ends = df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("_a", F.min), ("_b", F.max))])
    scaled = df.join(F.broadcast(ends))
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        scaled = scaled.withColumn(c, F.round(F.when(b > a, (F.col(c) - a) / (b - a)).otherwise(0.0), 6))
    return scaled.select(*df.columns)


@query(
    "minmax_normalize",
    "select p_partkey, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 6) as p_size, round((p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ()), 6) as p_retailprice from part",
)
def _(spark, sf_dir):
    return minmax_normalize(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


SPECIAL = ["[pad]", "[unk]", "[cls]", "[sep]", "[mask]"]
OPERATORS = ["=", "!=", ">", "<", "<=", ">="]
VOCABULARY_TOP = 100


def value_vocabulary(catalog: DataFrame, counts: DataFrame, top: int = VOCABULARY_TOP) -> DataFrame:
    """word_id, kind, owner, word: special tokens, tables, columns by table, the top values of each column, operators.

    Ranks are taken within a column; an id is the rank after the sizes of the groups before, and those are a row a column.
    """
    spark = catalog.sparkSession
    special = spark.createDataFrame([(0, "special", "", w, i) for i, w in enumerate(SPECIAL)] + [(4, "operator", "", w, i) for i, w in enumerate(OPERATORS)], "part int, kind string, owner string, word string, at long")
    tables = catalog.select("tab").distinct().select(F.lit(1), F.lit("table"), F.lit(""), F.col("tab"), F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("tab")).cast("long") - 1)
    columns = catalog.select(F.lit(2), F.lit("column"), F.col("tab"), F.col("col"), F.col("ordinal").cast("long") - 1)
    by_count = Window.partitionBy("col").orderBy(F.desc("n"), "val")
    values = counts.where("val is not null").withColumn("at", F.row_number().over(by_count)).where(F.col("at") <= top).select(F.lit(3), F.lit("value"), F.col("col"), F.col("val"), F.col("at").cast("long") - 1)
    words = special.union(tables).union(columns).union(values)
    groups = words.groupBy("part", F.col("owner").alias("_owner")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part", "_owner").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(F.col("part").alias("_part"), "_owner", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return words.join(F.broadcast(offsets), (F.col("part") == F.col("_part")) & (F.col("owner") == F.col("_owner"))).select((F.col("_offset") + F.col("at")).alias("word_id"), "kind", "owner", "word")


def kinds_of(columns: set[str] | None) -> dict[str, dict[str, str]]:
    """The star schema's columns by table, or those named; tables without any are left out."""
    kinds = {t: {c: k for c, k in of.items() if columns is None or c in columns} for t, of in TABLES.items()}
    return {t: of for t, of in kinds.items() if of}


def star_counts(spark: SparkSession, sf_dir: str, columns: set[str] | None = None) -> DataFrame:
    """value_counts of every column of the star schema, or of those named; no other is read."""
    found = [value_counts(read(spark, sf_dir, t), of) for t, of in kinds_of(columns).items()]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "col string, val string, n long")


def top_counts(df: DataFrame, kinds: dict[str, str], top: int) -> DataFrame:
    """col, val, n: the top rows of each column's value_counts, by n, then val, without null. A task keeps its best few; the distinct values are never sorted."""
    return reduce(DataFrame.unionByName, [value_counts(df, {c: k}).where("val is not null").orderBy(F.desc("n"), "val").limit(top) for c, k in kinds.items()])


def star_tops(spark: SparkSession, sf_dir: str, top: int = VOCABULARY_TOP, columns: set[str] | None = None) -> DataFrame:
    """top_counts of every column of the star schema, or of those named; no other is read."""
    found = [top_counts(read(spark, sf_dir, t), of, top) for t, of in kinds_of(columns).items()]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "col string, val string, n long")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_vocabulary(adapters.catalog(spark, sf_dir), star_tops(spark, sf_dir))


frame("cell_counts", " union all ".join(f"select '{c}' as col, {sql_text(c, k)} as val, count(*) as n from {t} group by {c}" for t, columns in TABLES.items() for c, k in columns.items()))
frame(
    "vocab",
    f"""
    select row_number() over (order by part, owner, rk) - 1 as word_id, kind, owner, word from (
      select 0 as part, 'special' as kind, '' as owner, w as word, i as rk from (values {', '.join(f'({i}, {quoted(w)})' for i, w in enumerate(SPECIAL))}) s(i, w)
      union all select 1, 'table', '', tab, row_number() over (order by tab) from (select distinct tab from catalog)
      union all select 2, 'column', tab, col, ordinal from catalog
      union all select 3, 'value', col, val, row_number() over (partition by col order by n desc, val) from (select col, val, sum(n) as n from cell_counts where val is not null group by col, val) qualify row_number() over (partition by col order by n desc, val) <= {VOCABULARY_TOP}
      union all select 4, 'operator', '', w, i from (values {', '.join(f'({i}, {quoted(w)})' for i, w in enumerate(OPERATORS))}) s(i, w))""",
)


@query("value_vocabulary", "select word_id, kind, owner, word from vocab")
def _(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query("vocabulary_ranges", "select kind, owner, min(word_id) as start_id, max(word_id) as end_id from vocab group by kind, owner")
def _(spark, sf_dir):
    return vocabulary(spark, sf_dir).groupBy("kind", "owner").agg(F.min("word_id").alias("start_id"), F.max("word_id").alias("end_id"))
