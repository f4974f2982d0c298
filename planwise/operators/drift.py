"""Drifted workloads: variants of logged queries and workloads drawn from them.

Every choice follows from keys (ids, positions, a seed) by modular arithmetic, so another run or
another partitioning makes the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from ..sources.adapters import derived
from ..sources.twins import frame
from .profile import OPERATORS, star_counts
from .querylog import prepared, typed
from .select import cut

SEED, VARIANTS = 666, 3


def keyed(*parts: Column, seed: int = SEED) -> Column:
    """A number from 0 to 999982 that the parts and the seed determine."""
    value = F.lit(seed).cast("long")
    for p in parts:
        value = F.pmod(value * 7919 + F.coalesce(p.cast("long"), F.lit(0)) * 104_729 + 12_345, F.lit(999_983))
    return value


def keyed_number(*parts: int, seed: int = SEED) -> int:
    value = seed
    for p in parts:
        value = (value * 7919 + p * 104_729 + 12_345) % 999_983
    return value


def keyed_sql(*parts: str, seed: int = SEED) -> str:
    value = f"{seed}::bigint"
    for p in parts:
        value = f"(({value} * 7919 + {p}::bigint * 104729 + 12345) % 999983)"
    return value


#: keyed() has so many values.
KEYS = 999_983


def drawn(size: Column, *parts: Column) -> Column:
    """A number from 0 to size - 1 that the parts determine. Beyond KEYS a second number, of the parts in reverse, says which of the runs of KEYS, so every one can come."""
    return F.pmod(keyed(*parts) + KEYS * F.pmod(keyed(*reversed(parts)), F.floor((size + (KEYS - 1)) / KEYS)), size)


def drawn_sql(size: str, *parts: str) -> str:
    return f"(({keyed_sql(*parts)} + {KEYS} * ({keyed_sql(*reversed(parts))} % (({size} + {KEYS - 1}) // {KEYS}))) % {size})"


def value_pool(counts: DataFrame, parts: int = 64) -> DataFrame:
    """col, rank (from 0), val, size: every value of a column, the most frequent first. counts: col, val, n.

    Values are ordered within chunks: those of one count between two of parts - 1 bounds, which hashes choose among the values;
    the chunks' sizes make the offsets. So no task orders a whole column, and ranks are exact wherever the bounds lie.
    """
    values = counts.where("val is not null").withColumn("_key", F.concat("col", F.lit("#"), "val"))
    marks = values.withColumn("_mark", F.xxhash64("_key")).where("_mark % 16 = 0").orderBy("_mark", "_key").select("_key").limit(16 * (parts - 1))
    bounds = sorted(r["_key"] for r in marks.collect())[15::16]  # a sixteenth of them, so parts are nearly even

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_key") < bounds[middle], part(low, middle)).otherwise(part(middle + 1, high))

    chunk = ["col", "n", "_part"]
    placed = values.withColumn("_part", part(0, len(bounds))).drop("_key")
    sizes = placed.groupBy(*chunk).agg(F.count("*").alias("_n"))  # a row a count and part
    whole = Window.partitionBy("col")
    before = whole.orderBy(F.desc("n"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size"))
    ranked = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*chunk).orderBy("val"))).join(offsets, chunk)
    return ranked.select("col", (F.col("_before") + F.col("_at") - 1).alias("rank"), "val", "size")


frame("value_pool", "select col, rank, val, count(*) over (partition by col) as size from (select col, val, row_number() over (partition by col order by n desc, val) - 1 as rank from (select col, val, sum(n) as n from cell_counts where val is not null group by col, val))")


def value_sizes(counts: DataFrame) -> DataFrame:
    """col, size: how many values value_pool has of a column. By count first, as there, so a plan with both counts the tables once."""
    return counts.where("val is not null").groupBy("col", "n").agg(F.count("*").alias("_n")).groupBy("col").agg(F.sum("_n").alias("size"))


def with_values(rows: DataFrame, pool: DataFrame, col: str, rank: str) -> DataFrame:
    """rows and val, the pool's value of that column and rank. Those wanted are found once each; rows without a column should differ in rank, so they spread."""
    wanted = rows.where(f"{col} is not null").select(F.col(col).alias("col"), F.col(rank).alias("rank")).distinct()
    found = pool.join(wanted, ["col", "rank"]).select(F.col("col").alias("_fc"), F.col("rank").alias("_fr"), "val")
    return rows.join(found, (F.coalesce(F.col(col), F.lit("")) == F.col("_fc")) & (F.col(rank) == F.col("_fr")), "left").drop("_fc", "_fr")


def value_slot() -> Column:
    """The column that a token is a literal of; null for other tokens."""
    return F.when(F.col("type").endswith("#value") & ~F.col("type").startswith("#"), F.regexp_extract("type", "^(.*)#value$", 1))


def columns_drawn_from(tokens: DataFrame) -> set[str]:
    """The catalog's columns that literals belong to, a few dozen at the most: only their values are counted."""
    known = [c for columns in adapters.TABLES.values() for c in columns]
    return {r[0] for r in tokens.select(value_slot().alias("_col")).where(F.col("_col").isin(known)).distinct().collect()}


def perturb_values(tokens: DataFrame, pool: DataFrame, sizes: DataFrame, variants: int) -> DataFrame:
    """query_id, variant, ord, pos, token: literals become another value of their column, any of it; all else stays."""
    each = tokens.withColumn("_slot", value_slot()).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    key = [F.col(c) for c in ("query_id", "variant", "ord", "pos")]
    chosen = each.join(F.broadcast(sizes), F.col("_slot") == F.col("col"), "left").withColumn("_rank", F.coalesce(drawn(F.col("size"), *key), keyed(*key)))  # a row a column
    return with_values(chosen.drop("_slot"), pool, "col", "_rank").select("query_id", "variant", "clause", "ord", "pos", "type", F.col("token").alias("original"), F.coalesce("val", "token").alias("token"))


frame(
    "varied",
    f"""
    select t.query_id, t.variant, t.clause, t.ord, t.pos, t.type, t.token as original, coalesce(p.val, t.token) as token from (
      select x.*, v.variant, s.size, {drawn_sql("s.size", "query_id", "variant", "ord", "pos")} as rank from (select *, case when type like '%#value' and type not like '#%' then regexp_extract(type, '^(.*)#value$', 1) end as slot from typed_tokens) x
      cross join range(1, {VARIANTS + 1}) v(variant) left join (select col, max(size) as size from value_pool group by col) s on s.col = x.slot) t
    left join value_pool p on p.col = t.slot and p.rank = t.rank""",
)


@derived
def value_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = typed(spark, sf_dir)
    counts = cut(star_counts(spark, sf_dir, columns_drawn_from(tokens)))
    return perturb_values(tokens, value_pool(counts), value_sizes(counts), VARIANTS)


@query("perturb_values", "select query_id, variant, ord, pos, token from varied where token <> original")
def _(spark, sf_dir):
    return value_variants(spark, sf_dir).where("token <> original").select("query_id", "variant", "ord", "pos", "token")


def edit_distance(tokens: DataFrame) -> DataFrame:
    """query_id, variant, edits: positions that differ."""
    return tokens.groupBy("query_id", "variant").agg(F.count(F.when(F.col("token") != F.col("original"), 1)).alias("edits"))


@query("edit_distance_tokens", "select query_id, variant, count(*) filter (token <> original) as edits from varied group by query_id, variant")
def _(spark, sf_dir):
    return edit_distance(value_variants(spark, sf_dir))


def perturb_budget(tokens: DataFrame, max_diff: int, keep_hundredths: int) -> DataFrame:
    """Each edit stays with a keyed chance; beyond max_diff edits of a query the original does."""
    edit = (F.col("token") != F.col("original")) & (F.pmod(keyed(F.col("pos"), F.col("ord"), F.col("query_id"), F.col("variant")), F.lit(100)) >= keep_hundredths)
    at = Window.partitionBy("query_id", "variant").orderBy("ord", "pos")
    marked = tokens.withColumn("_e", edit.cast("int")).withColumn("_k", F.sum("_e").over(at))
    return marked.withColumn("token", F.when((F.col("_e") == 1) & (F.col("_k") <= max_diff), F.col("token")).otherwise(F.col("original"))).drop("_e", "_k")


@query("perturb_budget", f"select query_id, variant, ord, pos, token from (select *, sum(e) over (partition by query_id, variant order by ord, pos) as k from (select *, (token <> original and {keyed_sql('pos', 'ord', 'query_id', 'variant')} % 100 >= 30)::int as e from varied)) where e = 1 and k <= 1")
def _(spark, sf_dir):
    return perturb_budget(value_variants(spark, sf_dir), 1, 30).where("token <> original").select("query_id", "variant", "ord", "pos", "token")


def perturb_columns(tokens: DataFrame, catalog: DataFrame, variants: int) -> DataFrame:
    """query_id, variant, ord, pos, token: a query's own columns of one table and type change places over its slots; joins stay."""
    slots = tokens.where(F.col("type").endswith("#column") & (F.col("clause") != "from")).join(F.broadcast(catalog.select("tab", "col", F.col("type").alias("_kind"))), F.col("token") == F.col("col"))
    each = slots.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    group = ["query_id", "variant", "tab", "_kind"]
    places = each.withColumn("_slot", F.row_number().over(Window.partitionBy(*group).orderBy("ord", "pos")))
    order = keyed(F.col("query_id"), F.col("variant"), F.col("ord"), F.col("pos"))
    mixed = each.withColumn("_slot", F.row_number().over(Window.partitionBy(*group).orderBy(order, "ord", "pos"))).select(*group, "_slot", F.col("token").alias("new"))
    return places.join(mixed, [*group, "_slot"]).select("query_id", "variant", "ord", "pos", F.col("new").alias("token"))


@query(
    "perturb_columns",
    f"""
select p.query_id, p.variant, p.ord, p.pos, m.token from slots p join (select query_id, variant, tab, kind, token, row_number() over (partition by query_id, variant, tab, kind order by {keyed_sql("query_id", "variant", "ord", "pos")}, ord, pos) as slot from slots) m
  on m.query_id = p.query_id and m.variant = p.variant and m.tab = p.tab and m.kind = p.kind and m.slot = p.slot""",
)
def _(spark, sf_dir):
    return perturb_columns(typed(spark, sf_dir), adapters.catalog(spark, sf_dir), VARIANTS)


frame("slots", f"select *, row_number() over (partition by query_id, variant, tab, kind order by ord, pos) as slot from (select t.query_id, v.variant, t.ord, t.pos, t.token, c.tab, c.type as kind from typed_tokens t join catalog c on t.token = c.col cross join range(1, {VARIANTS + 1}) v(variant) where t.type like '%#column' and t.clause <> 'from')")

SAME_KIND = {"max": ["max", "min"], "min": ["max", "min"], "and": ["and", "or"], "or": ["and", "or"], **{o: OPERATORS for o in OPERATORS}}


def perturb_all(tokens: DataFrame, catalog: DataFrame, pool: DataFrame, variants: int, max_diff: int = 5, sizes: DataFrame | None = None) -> DataFrame:
    """query_id, variant, ord, pos, token, original: columns of the tables used, operators, conjunctions, min and max, and literals change; joins, tables and clauses stay.

    A slot depends on the ones before it in its query (sort and group keys come from the select list, a
    literal follows its column, a clause does not repeat a column), so each (query, variant) is one
    small group. It draws a literal's rank; the value is joined later. A draw edits unless it is the literal's own rank in that column.
    """
    by_table = {r["tab"]: (r["c"], dict(zip(r["c"], r["k"]))) for r in catalog.groupBy("tab").agg(F.sort_array(F.collect_list(F.struct("col", "type"))).alias("_l")).select("tab", F.col("_l.col").alias("c"), F.col("_l.type").alias("k")).collect()}
    many = {r["col"]: r["size"] for r in (pool.groupBy("col").agg(F.max("size").alias("size")) if sizes is None else sizes).collect()}  # a row a column
    owner = {c: t for t, (columns, _) in by_table.items() for c in columns}
    shared = tokens.sparkSession.sparkContext.broadcast((by_table, many, owner))

    def vary(group: pd.DataFrame) -> pd.DataFrame:
        tables, many, owner = shared.value
        rows = group.sort_values(["ord", "pos"]).to_dict("records")
        moved: dict[str, str] = {}
        edits, seen, column = 0, {}, ""
        for r in rows:
            token, kind = r["original"], r["type"]
            parts = (r["query_id"], r["variant"], r["ord"], r["pos"])
            h, new = keyed_number(*parts), token
            r["col"], r["rank"] = None, h
            if kind.endswith("#column") and r["clause"] != "from":
                if token in moved and r["clause"] in ("group by", "order by"):
                    new = moved[token]
                elif edits < max_diff:
                    columns, kinds = tables[owner[token]]
                    free = [c for c in columns if kinds[c] == kinds[token] and c not in seen.setdefault(r["clause"], set())]
                    new = free[h % len(free)] if free else token
                seen.setdefault(r["clause"], set()).add(new)
                moved.setdefault(token, new)
                column = new
            elif token in SAME_KIND and kind in ("operator", "aggregator", "conjunction") and r["clause"] != "from" and edits < max_diff:
                new = SAME_KIND[token][h % len(SAME_KIND[token])]
            elif kind.endswith("#value") and not kind.startswith("#") and (edits < max_diff or column != kind[:-6]) and many.get(column):
                r["col"], r["rank"] = column, (h + KEYS * (keyed_number(*reversed(parts)) % -(-many[column] // KEYS))) % many[column]
                edits += r["rank"] != (r["_own"] or {}).get(column)
            edits += new != token
            r["token"] = new
        return pd.DataFrame(rows)[["query_id", "variant", "ord", "pos", "token", "original", "col", "rank"]]

    each = tokens.select("query_id", "clause", "ord", "pos", F.col("token").alias("original"), "type").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    texts = tokens.where(value_slot().isNotNull()).select(F.col("token").alias("val")).distinct()
    own = pool.join(texts, "val").groupBy(F.col("val").alias("original")).agg(F.map_from_entries(F.collect_list(F.struct("col", "rank"))).alias("_own"))  # a rank a column
    varied = each.join(own, "original", "left").groupBy("query_id", "variant").applyInPandas(lambda g: vary(g), "query_id long, variant int, ord int, pos int, token string, original string, col string, rank long")
    return with_values(varied, pool, "col", "rank").select("query_id", "variant", "ord", "pos", F.coalesce("val", "token").alias("token"), "original")


def columns_reached(tokens: DataFrame, catalog: DataFrame) -> set[str]:
    """The columns that perturb_all may draw a literal from: those of one table and type with the column before it in its query."""
    at = Window.partitionBy("query_id").orderBy("ord", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("type").endswith("#column") & (F.col("clause") != "from"), F.col("token")), ignorenulls=True).over(at)
    kinds = catalog.select("tab", "col", F.col("type").alias("_kind"))
    used = tokens.withColumn("col", near).where(value_slot().isNotNull()).select("col").distinct().join(F.broadcast(kinds), "col").select("tab", "_kind").distinct()
    return {r["col"] for r in kinds.join(used, ["tab", "_kind"], "left_semi").collect()}


@query("perturb_all")
def _(spark, sf_dir):
    tokens, catalog = typed(spark, sf_dir), adapters.catalog(spark, sf_dir)
    counts = cut(star_counts(spark, sf_dir, columns_reached(tokens, catalog)))
    return perturb_all(tokens, catalog, value_pool(counts), 1, sizes=value_sizes(counts))


def drift_groups(queries: DataFrame, variants: int) -> DataFrame:
    """query_id, variant, mode, max_diff (3 to 8), prop (0.3 to 0.8): how each variant is to be made."""
    each = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    h = keyed(F.col("query_id"), F.col("variant"))
    return each.select("query_id", "variant", F.element_at(F.array(*map(F.lit, ("all", "column", "value"))), (h % 3 + 1).cast("int")).alias("mode"), (3 + h % 6).cast("int").alias("max_diff"), F.round(0.3 + (h % 51) / 100.0, 2).alias("prop"))


@query("drift_groups", f"select query_id, variant::int as variant, list_extract(['all', 'column', 'value'], (h % 3 + 1)::int) as mode, (3 + h % 6)::int as max_diff, round(0.3::double + (h % 51) / 100.0::double, 2) as prop from (select query_id, variant, {keyed_sql('query_id', 'variant')} as h from workload cross join range(1, 11) v(variant))")
def _(spark, sf_dir):
    return drift_groups(prepared(spark, sf_dir), 10)


def drift_workloads(classes: DataFrame, count: int, size: int, variants: int, unique: bool) -> DataFrame:
    """workload_id, slot, class_id, variant, freq: workloads of a fixed size, sorted by class.

    unique takes each class at most once; else classes may repeat. Workloads with the same signature are left out but the first.
    """
    n = classes.agg(F.count("*").alias("_n"))
    ids = classes.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class_id")) - 1).alias("_i"), "class_id")  # templates, not queries
    if unique:
        every = classes.sparkSession.range(1, count + 1).withColumnRenamed("id", "workload_id").join(F.broadcast(ids))
        ranked = every.withColumn("_r", F.row_number().over(Window.partitionBy("workload_id").orderBy(keyed(F.col("workload_id"), F.col("_i")), "_i"))).where(f"_r <= {size}")
    else:
        slots = classes.sparkSession.range(1, count + 1).select(F.col("id").alias("workload_id"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("_r")).join(F.broadcast(n))
        ranked = slots.withColumn("_i", F.pmod(keyed(F.col("workload_id"), F.col("_r")), F.col("_n"))).join(F.broadcast(ids), "_i")
    drawn = ranked.select("workload_id", "_r", "class_id", (1 + keyed(F.col("_r"), F.col("workload_id")) % variants).alias("variant"), (1 + keyed(F.col("workload_id"), F.col("_r"), seed=7) % 1000).alias("freq"))
    slot = Window.partitionBy("workload_id").orderBy("class_id", "_r")
    placed = drawn.withColumn("slot", F.row_number().over(slot)).drop("_r")
    signature = placed.groupBy("workload_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "class_id", "variant"))), lambda x: F.concat_ws("/", x["class_id"].cast("string"), x["variant"].cast("string"))), ",").alias("_s"))
    first = signature.groupBy("_s").agg(F.min("workload_id").alias("workload_id"))
    return placed.join(first, "workload_id", "left_semi").select("workload_id", "slot", "class_id", "variant", "freq")


def classes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(F.col("template_id").alias("class_id")).distinct()


frame("classes", "select row_number() over (order by class_id) - 1 as i, class_id from (select distinct template_id as class_id from workload)")
_DRAWN = f"select workload_id, r, class_id, 1 + {keyed_sql('r', 'workload_id')} % 10 as variant, 1 + {keyed_sql('workload_id', 'r', seed=7)} % 1000 as freq from"
_UNIQUE = f"{_DRAWN} (select *, row_number() over (partition by workload_id order by {keyed_sql('workload_id', 'i')}, i) as r from classes cross join range(1, 51) w(workload_id) qualify r <= 12)"
_REPEATS = f"{_DRAWN} (select *, {keyed_sql('workload_id', 'r')} % (select count(*) from classes) as i from range(1, 51) w(workload_id) cross join range(1, 13) s(r)) join classes using (i)"


def workloads_sql(drawn: str) -> str:
    placed = f"select workload_id, row_number() over (partition by workload_id order by class_id, r)::int as slot, class_id, variant, freq from ({drawn})"
    return f"select workload_id, slot, class_id, variant, freq from ({placed}) semi join (select min(workload_id) as workload_id from (select workload_id, string_agg(class_id::varchar || '/' || variant::varchar, ',' order by slot) as s from ({placed}) group by workload_id) group by s) using (workload_id)"


@query("drift_workloads", workloads_sql(_REPEATS))
def _(spark, sf_dir):
    return drift_workloads(classes_of(spark, sf_dir), 50, 12, 10, False)


@query("random_workloads", workloads_sql(_UNIQUE))
def _(spark, sf_dir):
    return drift_workloads(classes_of(spark, sf_dir), 50, 12, 10, True)


def workload_splits(workloads: DataFrame, train: int, evaluation: int) -> DataFrame:
    """workload_id, split: distinct workloads in a keyed order, the first for training, the next for evaluation, the rest for tests."""
    ids = workloads.select("workload_id").distinct()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(keyed(F.col("workload_id")), "workload_id"))  # workloads, not queries
    return ids.withColumn("_p", place).select("workload_id", F.when(F.col("_p") <= train, "train").when(F.col("_p") <= train + evaluation, "eval").otherwise("test").alias("split"))


@query("workload_splits", f"select workload_id, case when p <= 30 then 'train' when p <= 40 then 'eval' else 'test' end as split from (select workload_id, row_number() over (order by {keyed_sql('workload_id')}, workload_id) as p from (select distinct workload_id from ({workloads_sql(_UNIQUE)})))")
def _(spark, sf_dir):
    return workload_splits(drift_workloads(classes_of(spark, sf_dir), 50, 12, 10, True), 30, 10)


def similar_workloads(classes: DataFrame, chains: int, length: int, size: int) -> DataFrame:
    """chain, step, class_id, freq: each step drops one class, adds one unseen, and redraws one frequency (Zipf-like). One group a chain."""
    ids = [r["class_id"] for r in classes.orderBy("class_id").collect()]  # templates
    heads = classes.sparkSession.range(chains).withColumnRenamed("id", "chain")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chain in group["chain"]:
            h = SEED + int(chain)

            def draw(n: int) -> int:
                nonlocal h
                h = (h * 7919 + 12_345) % 999_983
                return h % n

            pool = list(ids)
            now = {pool.pop(draw(len(pool))): 1 + draw(1000) for _ in range(min(size, len(ids)))}
            for step in range(length):
                out += [(int(chain), step, c, f) for c, f in sorted(now.items())]
                gone = sorted(now)[draw(len(now))]
                if pool:
                    now[pool.pop(draw(len(pool)))] = int(1000 / (1 + draw(100)) ** 1.5) + 1
                    del now[gone]
                    pool.append(gone)
                now[sorted(now)[draw(len(now))]] = int(1000 / (1 + draw(100)) ** 1.5) + 1
        return pd.DataFrame(out, columns=["chain", "step", "class_id", "freq"])

    return heads.groupBy("chain").applyInPandas(lambda g: walk(g), "chain long, step int, class_id int, freq long")


@query("similar_workloads")
def _(spark, sf_dir):
    return similar_workloads(classes_of(spark, sf_dir), 8, 10, 8)


def periodic_shift_workloads(classes: DataFrame, count: int, period: int, size: int) -> DataFrame:
    """workload_id, class_id, freq: the classes are drawn anew every period workloads, the frequencies each time."""
    every = classes.sparkSession.range(count).withColumnRenamed("id", "workload_id").withColumn("_g", F.floor(F.col("workload_id") / period)).join(F.broadcast(classes))
    ranked = every.withColumn("_r", F.row_number().over(Window.partitionBy("workload_id").orderBy(keyed(F.col("_g"), F.col("class_id")), "class_id"))).where(f"_r <= {size}")
    return ranked.select("workload_id", "class_id", (1 + keyed(F.col("workload_id"), F.col("class_id")) % 1000).alias("freq"))


@query("periodic_shift_workloads", f"select workload_id, class_id, 1 + {keyed_sql('workload_id', 'class_id')} % 1000 as freq from (select *, row_number() over (partition by workload_id order by {keyed_sql('workload_id // 5', 'class_id')}, class_id) as r from (select distinct class_id from classes) cross join range(0, 30) w(workload_id)) where r <= 6")
def _(spark, sf_dir):
    return periodic_shift_workloads(classes_of(spark, sf_dir), 30, 5, 6)


def assign_budgets(workloads: DataFrame, budgets: list[int]) -> DataFrame:
    pick = (keyed(F.col("workload_id")) % len(budgets) + 1).cast("int")
    return workloads.select("workload_id").distinct().select("workload_id", F.element_at(F.array(*map(F.lit, budgets)), pick).alias("budget"))


@query("assign_budgets", f"select workload_id, list_extract([250, 500, 1000, 2000], ({keyed_sql('workload_id')} % 4 + 1)::int) as budget from (select distinct workload_id from ({workloads_sql(_UNIQUE)}))")
def _(spark, sf_dir):
    return assign_budgets(drift_workloads(classes_of(spark, sf_dir), 50, 12, 10, True), [250, 500, 1000, 2000])
