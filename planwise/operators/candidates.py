"""Index candidates: enumeration, algebra (merge, split, prefix, extend, subsume), sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..registry import query
from ..sources import adapters
from ..sources.adapters import derived
from ..sources.twins import frame
from .profile import all_stats
from .querylog import columns_of, roles_of

#: Columns of an index at the most, rows under which a table gets no index, and an index key's bytes at the most.
WIDTH, LEAST_ROWS, KEY_BYTES = 2, 1000, 1700


def index_id(tab: str | Column = "tab", cols: str | Column = "cols") -> Column:
    """table#c1,c2"""
    return F.concat(F.col(tab) if isinstance(tab, str) else tab, F.lit("#"), F.array_join(cols, ","))


def permutations(columns: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """keys, tab, cols, width: ordered choices of 1 to width of a key's columns. Self-joins on key and table, no wider than asked."""
    one = columns.select(*keys, "tab", "col").distinct()
    level = one.select(*keys, "tab", F.array("col").alias("cols"))
    found = level
    for _ in range(width - 1):
        level = level.join(one, [*keys, "tab"]).where(~F.array_contains("cols", F.col("col"))).select(*keys, "tab", F.array_append("cols", F.col("col")).alias("cols"))
        found = found.union(level)
    return found.withColumn("width", F.size("cols")).withColumn("index_id", index_id())


def distinct_indexes(candidates: DataFrame) -> DataFrame:
    return candidates.select("index_id", "tab", "cols", "width").dropDuplicates(["index_id"])


def candidates_per_query(columns: DataFrame, width: int = WIDTH) -> DataFrame:
    """query_id, tab, cols, width, index_id.

    Queries that touch a table's columns alike share their permutations: column sets are permuted once each, then joined back.
    """
    sets = columns.groupBy("query_id", "tab").agg(F.array_join(F.sort_array(F.collect_set("col")), ",").alias("_set"))
    unique = sets.select("tab", "_set").distinct().select("_set", "tab", F.explode(F.split("_set", ",")).alias("col"))
    made = permutations(unique, ["_set"], width)
    return sets.join(made, ["tab", "_set"]).select("query_id", "tab", "cols", "width", "index_id")


frame(
    "candidate",
    """
    select query_id, tab, [col] as cols, 1 as width, tab || '#' || col as index_id from query_column
    union all select a.query_id, a.tab, [a.col, b.col], 2, a.tab || '#' || a.col || ',' || b.col from query_column a join query_column b on a.query_id = b.query_id and a.tab = b.tab and a.col <> b.col""",
)
frame("indexes", "select distinct index_id, tab, cols, width from candidate")


@derived
def candidates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_per_query(columns_of(spark, sf_dir))


def indexes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_indexes(candidates_of(spark, sf_dir))


def shown(df: DataFrame) -> DataFrame:
    """Arrays of names as text, so engines compare alike."""
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


@query("candidates_per_query", "select query_id, tab, array_to_string(cols, ',') as cols, width, index_id from candidate")
def _(spark, sf_dir):
    return shown(candidates_of(spark, sf_dir))


@query(
    "candidates_global",
    """
select tab || '#' || col as index_id, tab, 1 as width from catalog
union all select a.tab || '#' || a.col || ',' || b.col, a.tab, 2 from catalog a join catalog b on a.tab = b.tab and a.col <> b.col
union all select a.tab || '#' || a.col || ',' || b.col || ',' || c.col, a.tab, 3 from catalog a join catalog b on a.tab = b.tab and a.col <> b.col join catalog c on a.tab = c.tab and c.col not in (a.col, b.col)""",
)
def _(spark, sf_dir):
    return permutations(adapters.catalog(spark, sf_dir), [], 3).select("index_id", "tab", "width")


@query("single_column_candidates", "select distinct index_id, tab, 1 as width from candidate where width = 1")
def _(spark, sf_dir):
    return distinct_indexes(columns_of(spark, sf_dir).select("tab", F.array("col").alias("cols"), F.lit(1).alias("width"), F.concat("tab", F.lit("#"), "col").alias("index_id"))).select("index_id", "tab", "width")


def role_arrays(roles: DataFrame, predicates: DataFrame) -> DataFrame:
    """query_id, tab and arrays of columns in order of appearance: joins (J), equalities (EQ), ranges (R), group_by (G), order_by (O); tables of the query."""
    listed = roles.where("role in ('group_by', 'order_by')").select("query_id", "tab", "col", F.when(F.col("role") == "group_by", "G").otherwise("O").alias("kind"), "pos").union(predicates.select("query_id", "tab", "col", "kind", "pos"))

    def of_kind(k: str) -> Column:
        return F.array_distinct(F.transform(F.filter("_l", lambda x: x["kind"] == k), lambda x: x["col"])).alias(k)

    arrays = [of_kind(k) for k in ("J", "EQ", "R", "G", "O")]
    tables = roles.groupBy("query_id").agg(F.countDistinct("tab").alias("tables"))
    return listed.groupBy("query_id", "tab").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "col"))).alias("_l")).select("query_id", "tab", *arrays).join(tables, "query_id")


def predicate_kinds(roles: DataFrame, literals: DataFrame) -> DataFrame:
    """query_id, tab, col, kind, pos: J for columns compared with columns, EQ and R by the operator."""
    joined = roles.where("role = 'predicates' and pos < 2000").select("query_id", "tab", "col", F.lit("J").alias("kind"), "pos")
    compared = literals.select("query_id", "tab", "col", F.when(F.col("op") == "=", "EQ").otherwise("R").alias("kind"), F.lit(2000).alias("pos"))
    return joined.union(compared)


def candidates_rule(arrays: DataFrame) -> DataFrame:
    """query_id, index_id: group-by and order-by columns of single-table queries, J, EQ+R, J+R, J+EQ, J+EQ+R, and every single column."""
    r1 = F.slice("R", 1, 1)
    variants = [F.when(F.col("tables") == 1, F.col("G")), F.when(F.col("tables") == 1, F.col("O")), F.col("J"), F.concat("J", "EQ", r1), F.concat("EQ", r1), F.concat("J", r1), F.concat("J", "EQ")]
    singles = F.transform(F.array_distinct(F.concat("J", "EQ", "R", "G", "O")), lambda c: F.array(c))
    made = arrays.select("query_id", "tab", F.explode(F.array_union(F.array(*variants), singles)).alias("cols")).where("cols is not null and size(cols) > 0")
    return made.select("query_id", index_id(cols=F.array_distinct("cols")).alias("index_id")).distinct()


@query(
    "candidates_rule",
    """
select distinct query_id, tab || '#' || array_to_string(cols, ',') as index_id from (
  select query_id, tab, unnest(list_concat([j, list_concat(j, e, r), list_concat(e, r), list_concat(j, r), list_concat(j, e)], case when tables = 1 then [g, o] else [] end, list_transform(singles, lambda c: [c]))) as cols
  from (select query_id, tab, coalesce(list(col order by pos, col) filter (kind = 'J'), []) as j, coalesce(list(col order by pos, col) filter (kind = 'EQ'), []) as e,
      list_slice(coalesce(list(col order by pos, col) filter (kind = 'R'), []), 1, 1) as r, coalesce(list(col order by pos, col) filter (kind = 'G'), []) as g, coalesce(list(col order by pos, col) filter (kind = 'O'), []) as o, list(distinct col) as singles
    from (select query_id, tab, col, kind, pos from kinds union all select query_id, tab, col, case role when 'group_by' then 'G' else 'O' end, pos from clause_column where role in ('group_by', 'order_by')) group by query_id, tab) join (select query_id, count(distinct tab) as tables from clause_column group by query_id) using (query_id)) where len(cols) > 0""",
)
def _(spark, sf_dir):
    from .cost import literals_of

    roles = roles_of(spark, sf_dir)
    return candidates_rule(role_arrays(roles, predicate_kinds(roles, literals_of(spark, sf_dir))))


def candidates_with_includes(roles: DataFrame, width: int = WIDTH) -> DataFrame:
    """query_id, index_id, includes: the predicates' columns in every order as key, the rest of the payload as included columns."""
    keys = permutations(roles.where("role = 'predicates'"), ["query_id"], width)
    payload = roles.where("role = 'payload'").groupBy("query_id", "tab").agg(F.collect_set("col").alias("_p"))
    most = roles.where("role = 'predicates'").groupBy("query_id", "tab").agg(F.least(F.countDistinct("col"), F.lit(width)).alias("_most"))
    full = keys.join(most, ["query_id", "tab"]).where("width = _most").join(payload, ["query_id", "tab"], "left")
    return full.select("query_id", "index_id", F.array_join(F.sort_array(F.array_except(F.coalesce("_p", F.array().cast("array<string>")), "cols")), ",").alias("includes"))


@query(
    "candidates_with_includes",
    """
select k.query_id, k.tab || '#' || array_to_string(k.cols, ',') as index_id, coalesce((select string_agg(distinct p.col, ',' order by p.col) from clause_column p where p.role = 'payload' and p.query_id = k.query_id and p.tab = k.tab and not list_contains(k.cols, p.col)), '') as includes
from (select query_id, tab, [col] as cols from clause_column where role = 'predicates' union all
  select a.query_id, a.tab, [a.col, b.col] from clause_column a join clause_column b on a.query_id = b.query_id and a.tab = b.tab and a.col <> b.col where a.role = 'predicates' and b.role = 'predicates') k
join (select query_id, tab, least(count(distinct col), 2) as most from clause_column where role = 'predicates' group by query_id, tab) m on k.query_id = m.query_id and k.tab = m.tab and len(k.cols) = m.most""",
)
def _(spark, sf_dir):
    return candidates_with_includes(roles_of(spark, sf_dir))


@query(
    "candidates_condition_rule",
    """
select distinct query_id, tab || '#' || array_to_string(cols, ',') as index_id from (
  select query_id, tab, [col] as cols from kinds where kind in ('J', 'EQ')
  union all select a.query_id, a.tab, [a.col, b.col] from kinds a join kinds b on a.query_id = b.query_id and a.tab = b.tab and a.col <> b.col where a.kind in ('J', 'EQ') and b.kind in ('J', 'EQ', 'R'))""",
)
def _(spark, sf_dir):
    """Join and equality columns in every order; a range column may come last."""
    from .cost import literals_of

    roles = roles_of(spark, sf_dir)
    kinds = predicate_kinds(roles, literals_of(spark, sf_dir))
    return candidates_condition_rule(kinds).select("query_id", "index_id")


def candidates_condition_rule(kinds: DataFrame, width: int = WIDTH) -> DataFrame:
    heads = permutations(kinds.where("kind in ('J', 'EQ')"), ["query_id"], width)
    shorter = heads.where(F.col("width") < width).select("query_id", "tab", "cols")
    ranged = shorter.join(kinds.where("kind = 'R'").select("query_id", "tab", "col").distinct(), ["query_id", "tab"]).where(~F.array_contains("cols", F.col("col")))
    tails = ranged.select("query_id", index_id(cols=F.array_append("cols", F.col("col"))).alias("index_id"))
    return heads.select("query_id", "index_id").union(tails).distinct()


#: Rows under which a table gets no arm, and the share of a table's rows that an arm for its payload alone is worth.
ARM_ROWS, PAYLOAD_WORTH = 10_000, 0.001


def bandit_arms(roles: DataFrame, selectivity: DataFrame, rows: DataFrame, width: int = WIDTH, least_rows: int = ARM_ROWS) -> DataFrame:
    """query_id, index_id, value, whole (all columns of its kind that the query has there).

    Predicate columns in every order up to width: (1 - selectivity) * share of the predicate columns * rows. Tables with
    payload only: its columns, if no more than width, in order of appearance: 0.001 * rows. A query's repeats have one value, so their mean is it.
    roles: as clause_columns gives them. selectivity: query_id, tab, selectivity (1 where missing). rows: tab, rows.
    """
    large = rows.where(F.col("rows") >= least_rows).select("tab", "rows")
    predicates = roles.where("role = 'predicates'").select("query_id", "tab", "col").distinct()
    counts = predicates.groupBy("query_id", "tab").agg(F.count("*").alias("_n"))
    ordered = permutations(predicates, ["query_id"], width).join(counts, ["query_id", "tab"]).join(selectivity, ["query_id", "tab"], "left").join(large, "tab")
    worth = (1 - F.coalesce("selectivity", F.lit(1.0))) * F.col("width") / F.col("_n") * F.col("rows")
    first = ordered.select("query_id", "index_id", rounded(worth, 4).alias("value"), (F.col("width") == F.col("_n")).alias("whole"))
    payload = roles.where("role = 'payload'").join(counts, ["query_id", "tab"], "left_anti").groupBy("query_id", "tab", "col").agg(F.min("pos").alias("pos"))
    listed = payload.groupBy("query_id", "tab").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda x: x["col"]).alias("cols"))
    second = listed.where(F.size("cols") <= width).join(large, "tab").select("query_id", index_id().alias("index_id"), rounded(PAYLOAD_WORTH * F.col("rows"), 4).alias("value"), F.lit(True).alias("whole"))
    return first.union(second)


frame("arm_predicate", "select distinct query_id, tab, col from clause_column where role = 'predicates'")
frame("arm_count", "select query_id, tab, count(*) as n from arm_predicate group by query_id, tab")
frame("arm_rows", f"select distinct tab, rows from catalog where rows >= {ARM_ROWS}")


@query(
    "bandit_arms",
    f"""
select k.query_id, k.tab || '#' || array_to_string(k.cols, ',') as index_id, round((1 - coalesce(s.selectivity, 1.0)) * len(k.cols) / n * rows, 4) as value, len(k.cols) = n as whole
from (select query_id, tab, [col] as cols from arm_predicate union all select a.query_id, a.tab, [a.col, b.col] from arm_predicate a join arm_predicate b on a.query_id = b.query_id and a.tab = b.tab and a.col <> b.col) k
join arm_count using (query_id, tab) join arm_rows using (tab) left join read_share s on s.plan_id = k.query_id and s.tab = k.tab
union all select query_id, tab || '#' || array_to_string(cols, ','), round({PAYLOAD_WORTH} * rows, 4), true
from (select query_id, tab, list(col order by pos, col) as cols from (select query_id, tab, col, min(pos) as pos from clause_column where role = 'payload' group by query_id, tab, col) p
  where not exists (select 1 from arm_count c where c.query_id = p.query_id and c.tab = p.tab) group by query_id, tab) join arm_rows using (tab) where len(cols) <= {WIDTH}""",
)
def _(spark, sf_dir):
    from ..plans.planlog import nodes_of, table_selectivity
    from .cost import table_rows

    rows = table_rows(spark, sf_dir)
    shares = table_selectivity(nodes_of(spark, sf_dir), rows).withColumnRenamed("plan_id", "query_id")
    return bandit_arms(roles_of(spark, sf_dir), shares, rows)


def merge_candidates(indexes: DataFrame, width: int) -> DataFrame:
    """a, b, merged: A's columns, then those of B that A lacks, cut to width."""
    a = indexes.select(F.col("index_id").alias("a"), "tab", F.col("cols").alias("_a"))
    b = indexes.select(F.col("index_id").alias("b"), "tab", F.col("cols").alias("_b"))
    return a.join(b, "tab").where("a != b").select("a", "b", index_id(cols=F.slice(F.array_union("_a", "_b"), 1, width)).alias("merged"))


@query(
    "merge_candidates",
    "select a.index_id as a, b.index_id as b, a.tab || '#' || array_to_string(list_slice(list_concat(a.cols, list_filter(b.cols, lambda c: not list_contains(a.cols, c))), 1, 3), ',') as merged from indexes a join indexes b on a.tab = b.tab and a.index_id <> b.index_id",
)
def _(spark, sf_dir):
    return merge_candidates(indexes_of(spark, sf_dir), 3)


def split_candidates(indexes: DataFrame) -> DataFrame:
    """a, b, common, rest_a, rest_b for pairs that share columns: they meet on a shared column, not on the table alone."""
    by_column = indexes.select("index_id", "tab", "cols", F.explode("cols").alias("_c"))
    a, b = (by_column.select(F.col("index_id").alias(n), "tab", "_c", F.col("cols").alias(f"_{n}")) for n in "ab")
    pairs = a.join(b, ["tab", "_c"]).where("a < b").drop("_c").dropDuplicates(["a", "b"])
    join = lambda x: F.array_join(x, ",")
    return pairs.select("a", "b", join(F.array_intersect("_a", "_b")).alias("common"), join(F.array_except("_a", "_b")).alias("rest_a"), join(F.array_except("_b", "_a")).alias("rest_b"))


@query(
    "split_candidates",
    """
select a, b, array_to_string(list_filter(x, lambda c: list_contains(y, c)), ',') as common, array_to_string(list_filter(x, lambda c: not list_contains(y, c)), ',') as rest_a, array_to_string(list_filter(y, lambda c: not list_contains(x, c)), ',') as rest_b
from (select a.index_id as a, b.index_id as b, a.cols as x, b.cols as y from indexes a join indexes b on a.tab = b.tab and a.index_id < b.index_id) where list_has_any(x, y)""",
)
def _(spark, sf_dir):
    return split_candidates(indexes_of(spark, sf_dir))


def prefix_candidates(indexes: DataFrame) -> DataFrame:
    """index_id, prefix_id, rank: proper prefixes, the longest first."""
    lengths = F.sequence(F.lit(1), F.size("cols") - 1)
    longer = indexes.where(F.size("cols") > 1).select("index_id", "tab", "cols", F.explode(lengths).alias("_n"))
    return longer.select("index_id", index_id(cols=F.slice("cols", F.lit(1), F.col("_n"))).alias("prefix_id"), (F.size("cols") - F.col("_n")).alias("rank"))


@query("prefix_candidates", "select index_id, tab || '#' || cols[1] as prefix_id, 1 as rank from indexes where width = 2")
def _(spark, sf_dir):
    return prefix_candidates(indexes_of(spark, sf_dir))


def extend_candidates(indexes: DataFrame, columns: DataFrame) -> DataFrame:
    """index_id, extended: one more column of the table."""
    return indexes.join(columns.select("tab", "col").distinct(), "tab").where(~F.array_contains("cols", F.col("col"))).select("index_id", index_id(cols=F.array_append("cols", F.col("col"))).alias("extended"))


@query("extend_candidates", "select index_id, index_id || ',' || col as extended from indexes join workload_column using (tab) where width = 1 and not list_contains(cols, col)")
def _(spark, sf_dir):
    return extend_candidates(indexes_of(spark, sf_dir).where("width = 1"), columns_of(spark, sf_dir))


def subsumed_pairs(indexes: DataFrame) -> DataFrame:
    """index_id, subsumed: B is a proper prefix of A. Prefixes are exploded, so this is an equi-join."""
    prefixes = prefix_candidates(indexes).select("index_id", F.col("prefix_id").alias("subsumed"))
    return prefixes.join(indexes.select(F.col("index_id").alias("subsumed")), "subsumed", "left_semi").select("index_id", "subsumed")


@query("subsumed_pairs", "select a.index_id, b.index_id as subsumed from indexes a join indexes b on a.tab = b.tab and len(a.cols) > len(b.cols) and list_slice(a.cols, 1, len(b.cols)) = b.cols")
def _(spark, sf_dir):
    return subsumed_pairs(indexes_of(spark, sf_dir))


def index_sizes(indexes: DataFrame, stats: DataFrame) -> DataFrame:
    """index_id, tab, cols, width, size_bytes: rows times header 6, key, and 2 for nullable ones, 2 and 2 more for each text column; keys beyond KEY_BYTES are left out."""
    each = indexes.select("index_id", "tab", F.explode("cols").alias("col")).join(F.broadcast(stats.select("tab", "col", "rows", "width", (F.col("lo").isNull() & (F.col("width") != 8)).cast("int").alias("_text")).withColumnRenamed("width", "_width")), ["tab", "col"])
    sums = each.groupBy("index_id").agg(F.sum("_width").alias("_key"), F.max("rows").alias("_rows"), F.sum("_text").alias("_texts"))
    sized = indexes.join(sums, "index_id").where(F.col("_key") <= KEY_BYTES)
    return sized.select("index_id", "tab", "cols", "width", F.ceil(F.col("_rows") * (6 + F.col("_key") + 2 + F.when(F.col("_texts") > 0, 2 + 2 * F.col("_texts")).otherwise(0))).alias("size_bytes"))


frame(
    "index_sizes",
    f"""
    select index_id, tab, cols, width, ceil(rows * (6 + k + 2 + case when texts > 0 then 2 + 2 * texts else 0 end))::bigint as size_bytes from (
      select i.index_id, i.tab, i.cols, i.width, sum(s.width) as k, max(s.rows) as rows, sum((s.lo is null and s.width <> 8)::int) as texts
      from indexes i join column_stats s on i.tab = s.tab and list_contains(i.cols, s.col) group by all) where k <= {KEY_BYTES}""",
)


@derived
def sized_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_sizes(indexes_of(spark, sf_dir), all_stats(spark, sf_dir))


@query("index_size", "select index_id, tab, width, size_bytes from index_sizes")
def _(spark, sf_dir):
    return sized_of(spark, sf_dir).select("index_id", "tab", "width", "size_bytes")


def index_delta_sizes(sized: DataFrame) -> DataFrame:
    """index_id, delta_bytes: beyond the index without the last column."""
    parent = sized.select(F.col("index_id").alias("_parent"), F.col("size_bytes").alias("_size"))
    own = sized.withColumn("_p", F.when(F.col("width") > 1, index_id(cols=F.slice("cols", F.lit(1), F.col("width") - 1))))
    return own.join(parent, F.col("_p") == F.col("_parent"), "left").select("index_id", (F.col("size_bytes") - F.coalesce("_size", F.lit(0))).alias("delta_bytes"))


@query("index_delta_size", "select a.index_id, a.size_bytes - coalesce(b.size_bytes, 0) as delta_bytes from index_sizes a left join index_sizes b on a.width = 2 and b.index_id = a.tab || '#' || a.cols[1]")
def _(spark, sf_dir):
    return index_delta_sizes(sized_of(spark, sf_dir))


def filter_budget(sized: DataFrame, budget_mb: float, used_bytes: int = 0) -> DataFrame:
    """Those that fit what is left of the budget; a megabyte is 10^6 bytes."""
    return sized.where(F.col("size_bytes") + used_bytes <= budget_mb * 1_000_000)


@query("filter_budget", "select index_id, size_bytes from index_sizes where size_bytes + 100000 <= 500000")
def _(spark, sf_dir):
    return filter_budget(sized_of(spark, sf_dir), 0.5, 100_000).select("index_id", "size_bytes")


def valid_extensions(indexes: DataFrame, chosen: DataFrame) -> DataFrame:
    """index_id, valid: children of a chosen index become legal, its siblings of equal width and prefix illegal. Single columns are legal until then."""
    parent = F.when(F.col("width") > 1, index_id(cols=F.slice("cols", F.lit(1), F.col("width") - 1))).otherwise(F.lit(""))
    rows = indexes.withColumn("_parent", parent)
    taken = rows.join(chosen.select("index_id"), "index_id", "left_semi").select(F.col("index_id").alias("_chosen"), F.col("_parent").alias("_blocked"), F.col("width").alias("_w"))
    child = rows.join(taken.select(F.col("_chosen").alias("_parent")), "_parent", "left_semi").select("index_id", F.lit(1).alias("_child"))
    sibling = rows.join(taken.where("_w > 1").select(F.col("_blocked").alias("_parent")).distinct(), "_parent", "left_semi").select("index_id", F.lit(1).alias("_sibling"))
    marked = rows.join(child, "index_id", "left").join(sibling, "index_id", "left").join(chosen.select("index_id", F.lit(1).alias("_own")).distinct(), "index_id", "left")
    return marked.select("index_id", (F.col("_own").isNull() & F.col("_sibling").isNull() & ((F.col("width") == 1) | F.col("_child").isNotNull())).alias("valid"))


CHOSEN = ["lineitem#l_quantity", "orders#o_totalprice", "lineitem#l_quantity,l_shipdate"]


@query(
    "valid_extensions",
    f"""
select index_id, not own and not sibling and (width = 1 or child) as valid from (
  select index_id, width, index_id in {tuple(CHOSEN)} as own, width = 2 and tab || '#' || cols[1] in {tuple(CHOSEN)} as child,
    width = 2 and tab || '#' || cols[1] in (select tab || '#' || cols[1] from indexes where width = 2 and index_id in {tuple(CHOSEN)}) as sibling from indexes)""",
)
def _(spark, sf_dir):
    return valid_extensions(indexes_of(spark, sf_dir), spark.createDataFrame([(c,) for c in CHOSEN], "index_id string"))


def index_combinations(candidates: DataFrame, most: int = 2) -> DataFrame:
    """combination, size: unordered sets of 1 to most candidates of one query, unioned over the workload.

    Queries with the same candidates share their sets, which are made once.
    """
    sets = candidates.groupBy("query_id").agg(F.sort_array(F.collect_set("index_id")).alias("_all")).select("_all").distinct()
    one = sets.select(F.xxhash64("_all").alias("_s"), F.explode("_all").alias("_i"))
    level = one.select("_s", F.array("_i").alias("_c"))
    found = level
    for _ in range(most - 1):
        level = level.join(one, "_s").where(F.element_at("_c", -1) < F.col("_i")).select("_s", F.array_append("_c", F.col("_i")).alias("_c"))
        found = found.union(level)
    return found.select(F.array_join("_c", ";").alias("combination"), F.size("_c").alias("size")).distinct()


@query("index_combinations", "select distinct index_id as combination, 1 as size from candidate union all select distinct a.index_id || ';' || b.index_id, 2 from candidate a join candidate b on a.query_id = b.query_id and a.index_id < b.index_id")
def _(spark, sf_dir):
    return index_combinations(candidates_of(spark, sf_dir))
