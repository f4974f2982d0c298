"""Plan logs: trees of JSON become rows of nodes, and these become features.

Only `flatten_plan` walks a tree, in Arrow batches with a stack of its own, so depth has no bound;
everything after it is relational.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators.querylog import prepared, term_space, tfidf, tfidf_sql
from ..registry import query
from ..sources.adapters import derived
from ..sources.twins import frame

#: Operator types by their place in a channel vector.
CHANNEL_TYPES = ["Aggregate", "Bitmap Heap Scan", "Bitmap Index Scan", "BitmapAnd", "BitmapOr", "Gather", "Gather Merge", "Hash", "Hash Join", "Index Only Scan", "Index Scan", "Materialize", "Merge Join", "Nested Loop", "Result", "Seq Scan", "Sort"]
JOINS, SCANS = ["Hash Join", "Merge Join", "Nested Loop"], ["Bitmap Heap Scan", "Bitmap Index Scan", "Index Scan", "Index Only Scan", "Seq Scan"]
#: Operators that a bag counts, and those of a filter's feature vector.
INTERESTING = ["Seq Scan", "Hash Join", "Nested Loop", "CTE Scan", "Index Only Scan", "Index Scan", "Merge Join", "Sort"]
FILTER_TYPES = [*JOINS, "Sort", "Aggregate", *SCANS]
#: Fixed value: the distance of nodes that no path joins.
UNREACHABLE = 60


def scan_json(shift: int) -> str:
    """SQL for either engine: an index scan for every third query, else a sequential one."""
    tab = f"case (query_id + {shift}) % 3 when 0 then 'lineitem' when 1 then 'orders' else 'part' end"
    col = f"case (query_id + {shift}) % 3 when 0 then 'l_quantity' when 1 then 'o_totalprice' else 'p_size' end"
    cond = f"concat('(', {col}, ' < ', cast(query_id % 50 as string), ')')"
    return (
        f"""concat('{{"Node Type":"', case when (query_id + {shift}) % 2 = 0 then 'Index Scan","Index Name":"' else 'Seq Scan","Alias":"' end, {tab}, case when (query_id + {shift}) % 2 = 0 then concat('#', {col}) else '' end,"""
        f"""'","Relation Name":"', {tab}, '","Total Cost":', cast(100 + (query_id * 37 + {shift}) % 900 as string), ',"Plan Rows":', cast(10 + (query_id * 13 + {shift}) % 5000 as string), ',"', case when (query_id + {shift}) % 2 = 0 then 'Index Cond' else 'Filter' end, '":"', {cond}, '"}}')"""
    )


def node_json(kind: str, cost: int, extra: str, *plans: str) -> str:
    inner = ", ',', ".join(plans)
    return f"""concat('{{"Node Type":"{kind}","Total Cost":', cast({cost} + (query_id * 41) % 700 as string), ',"Plan Rows":', cast(5 + (query_id * 17) % 3000 as string), '{extra},"Plans":[', {inner}, ']}}')"""


JOIN_COND, SORT_KEY = ',"Hash Cond":"(l_orderkey = o_orderkey)"', ',"Sort Key":["o_orderdate","l_quantity DESC"]'
PLAN_JSON = f"""case query_id % 5
    when 0 then {scan_json(1)}
    when 1 then {node_json("Sort", 1000, SORT_KEY, scan_json(2))}
    when 2 then {node_json("Aggregate", 3000, "", node_json("Hash Join", 2000, JOIN_COND, scan_json(0), node_json("Hash", 1500, "", scan_json(1))))}
    when 3 then {node_json("Hash Join", 2500, JOIN_COND, scan_json(3), scan_json(5))}
    else {node_json("Aggregate", 4000, "", node_json("Sort", 3500, SORT_KEY, node_json("Nested Loop", 2800, "", scan_json(0), scan_json(4))))} end"""
frame("plan_log", f"select query_id as plan_id, {PLAN_JSON} as plan, 50.0 + (query_id * 31) % 5000 as actual_cost from workload")
frame("node_tree", "select plan_id, plan::json as node, '' as path, 0 as depth, 0 as child_no from plan_log union all select plan_id, json_extract(node, '$.Plans[' || i || ']'), path || '.' || lpad(i::varchar, 3, '0'), depth + 1, i::int from node_tree, unnest(range(coalesce(json_array_length(node, '$.Plans'), 0)::bigint)) u(i)")
frame(
    "plan_shape",
    """
    select plan_id, path, depth, child_no, json_extract_string(node, '$."Node Type"') as node_type, json_extract(node, '$."Total Cost"')::double as total_cost, json_extract(node, '$."Plan Rows"')::double as plan_rows,
      coalesce(json_extract_string(node, '$."Relation Name"'), '') as relation, coalesce(json_extract_string(node, '$."Index Name"'), '') as index_name,
      coalesce(json_extract_string(node, '$."Filter"'), json_extract_string(node, '$."Index Cond"'), json_extract_string(node, '$."Hash Cond"'), '') as cond,
      coalesce(array_to_string(json_extract_string(node, '$."Sort Key"[*]'), ';'), '') as sort_key, (row_number() over (partition by plan_id order by path) - 1)::int as node_id,
      coalesce(json_array_length(node, '$.Plans'), 0) = 0 as leaf from node_tree""",
)
frame(
    "plan_height",
    "select a.plan_id, a.node_id, max(d.depth) - a.depth + 1 as height from plan_shape a join plan_shape d on a.plan_id = d.plan_id and starts_with(d.path, a.path) and (d.path = a.path or substr(d.path, length(a.path) + 1, 1) = '.') group by a.plan_id, a.node_id, a.depth",
)
frame(
    "plan_weight",
    """
    select n.plan_id, n.node_id, round(sum(l.total_cost * coalesce(l.p, 1)), 4) as w_cost, round(sum(l.plan_rows * coalesce(l.p, 1)), 4) as w_rows from plan_shape n join (
      select n.plan_id, n.node_id, l.node_id as leaf_id, any_value(l.total_cost) as total_cost, any_value(l.plan_rows) as plan_rows, product(case when m.node_id is null then 1 else h.height end) as p
      from plan_shape n join plan_shape l on l.leaf and l.plan_id = n.plan_id and starts_with(l.path, n.path)
      left join plan_shape m on m.plan_id = n.plan_id and starts_with(l.path, m.path) and starts_with(m.path, n.path) and m.path <> n.path
      left join plan_height h on h.plan_id = m.plan_id and h.node_id = m.node_id group by n.plan_id, n.node_id, l.node_id) l on l.plan_id = n.plan_id and l.node_id = n.node_id
    group by n.plan_id, n.node_id""",
)
frame(
    "plan_node",
    """
    select s.plan_id, s.node_id, coalesce(p.node_id, -1) as parent_id, s.child_no, s.depth, h.height::int as height, (row_number() over (partition by s.plan_id order by s.path || '.~') - 1)::int as post_id,
      s.node_type, s.total_cost, s.plan_rows, s.relation, s.index_name, s.cond, s.sort_key, w.w_cost, w.w_rows, s.path, s.leaf
    from plan_shape s join plan_height h using (plan_id, node_id) join plan_weight w using (plan_id, node_id) left join plan_shape p on p.plan_id = s.plan_id and s.depth > 0 and p.path = substr(s.path, 1, length(s.path) - 4)""",
)

NODE = "plan_id long, node_id int, parent_id int, child_no int, depth int, height int, post_id int, ancestors array<int>, node_type string, total_cost double, plan_rows double, relation string, index_name string, cond string, sort_key string, w_cost double, w_rows double"
CONDITIONS = ("Filter", "Index Cond", "Hash Cond", "Merge Cond", "Join Filter", "Recheck Cond")


def plan_rows(plan_id: int, text: str) -> list[dict]:
    """A plan's nodes in pre-order. Weighted sums: a leaf's own value; an inner node's sum of its children's, each times its height."""
    root = json.loads(text)
    nodes: list[dict] = []
    stack = [(root, -1, 0, 0, [])]
    while stack:
        raw, parent, child_no, depth, ancestors = stack.pop()
        i = len(nodes)
        nodes.append(
            {
                "plan_id": plan_id, "node_id": i, "parent_id": parent, "child_no": child_no, "depth": depth, "height": 1, "post_id": 0, "ancestors": ancestors, "node_type": raw.get("Node Type"), "total_cost": float(raw.get("Total Cost", 0)),
                "plan_rows": float(raw.get("Plan Rows", 0)), "relation": raw.get("Relation Name", ""), "index_name": raw.get("Index Name", ""), "cond": next((raw[c] for c in CONDITIONS if c in raw), ""),
                "sort_key": ";".join(raw.get("Sort Key", [])), "w_cost": 0.0, "w_rows": 0.0, "_children": [],
            }
        )
        if parent >= 0:
            nodes[parent]["_children"].append(i)
        children = raw.get("Plans", [])
        stack += [(c, i, k, depth + 1, [*ancestors, i]) for k, c in reversed(list(enumerate(children)))]
    for n in reversed(nodes):  # children come after their parent in pre-order
        if not (own := n.pop("_children")):
            n["w_cost"], n["w_rows"] = n["total_cost"], n["plan_rows"]
        else:
            n["height"] = 1 + max(nodes[c]["height"] for c in own)
            n["w_cost"], n["w_rows"] = (sum(nodes[c]["height"] * nodes[c][k] for c in own) for k in ("w_cost", "w_rows"))
            n["_last"] = own
    post, todo = 0, [(0, False)]
    while todo:
        i, seen = todo.pop()
        own = nodes[i].get("_last", [])
        if seen or not own:
            nodes[i]["post_id"] = post
            post += 1
        else:
            todo += [(i, True), *((c, False) for c in reversed(own))]
    for n in nodes:
        n.pop("_last", None)
    return nodes


def flatten_plan(plans: DataFrame, plan_id: str = "plan_id", plan: str = "plan") -> DataFrame:
    """A row a node, in one pass without a shuffle. Null plans have no nodes."""
    kinds = pa.schema([("plan_id", pa.int64()), *((n, pa.int32()) for n in ("node_id", "parent_id", "child_no", "depth", "height", "post_id")), ("ancestors", pa.list_(pa.int32())), ("node_type", pa.string()), ("total_cost", pa.float64()), ("plan_rows", pa.float64()), *((n, pa.string()) for n in ("relation", "index_name", "cond", "sort_key")), ("w_cost", pa.float64()), ("w_rows", pa.float64())])

    def walk(batches):
        for batch in batches:
            rows: list[dict] = []
            for i, text in zip(batch.column(0), batch.column(1)):
                if text.as_py() is not None:
                    rows += plan_rows(i.as_py(), text.as_py())
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return plans.select(F.col(plan_id).cast("long"), plan).mapInArrow(walk, NODE)


def plan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(F.col("query_id").alias("plan_id"), F.expr(PLAN_JSON).alias("plan"), (F.lit(50.0) + (F.col("query_id") * 31) % 5000).alias("actual_cost"))


@derived
def nodes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_plan(plan_log(spark, sf_dir))


@query("plan_log", "select plan_id, plan, actual_cost::double as actual_cost from plan_log")
def _(spark, sf_dir):
    return plan_log(spark, sf_dir)


@query("flatten_plan", "select plan_id, node_id, parent_id, child_no, depth, height, post_id, node_type, total_cost, plan_rows, relation, index_name, cond, sort_key, w_cost, w_rows from plan_node")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).drop("ancestors")


@query("operator_counts", "select node_type, count(*) as n, count(distinct plan_id) as plans from plan_node group by node_type")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"), F.countDistinct("plan_id").alias("plans"))


@query("node_height", "select plan_id, max(height) as height, count(*) as nodes, max(depth) as depth from plan_node group by plan_id")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).groupBy("plan_id").agg(F.max("height").alias("height"), F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query("weighted_sums", "select plan_id, w_cost, w_rows from plan_node where node_id = 0")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).where("node_id = 0").select("plan_id", "w_cost", "w_rows")


def in_order(nodes: DataFrame, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "node_type"))), lambda x: x["node_type"]), ">")


@query("traversal_order", "select plan_id, string_agg(node_type, '>' order by node_id) as pre_order, string_agg(node_type, '>' order by post_id) as post_order from plan_node group by plan_id")
def _(spark, sf_dir):
    nodes = nodes_of(spark, sf_dir)
    return nodes.groupBy("plan_id").agg(in_order(nodes, "node_id").alias("pre_order"), in_order(nodes, "post_id").alias("post_order"))


def plan_channels(nodes: DataFrame, types: list[str] = CHANNEL_TYPES) -> DataFrame:
    """plan_id and four arrays in the types' order: sums of cost, rows, weighted cost and weighted rows; other types are left out."""
    sums = [F.sum(F.when(F.col("node_type") == t, F.col(v)).otherwise(0.0)) for v in ("total_cost", "plan_rows", "w_cost", "w_rows") for t in types]
    n = len(types)
    return nodes.groupBy("plan_id").agg(*[F.array(*sums[i * n : (i + 1) * n]).alias(c) for i, c in enumerate(("cost", "rows", "w_cost", "w_rows"))])


frame("channels", "select plan_id, " + ", ".join(f"[{', '.join(f"coalesce(sum({v}) filter (node_type = '{t}'), 0.0)" for t in CHANNEL_TYPES)}] as {c}" for c, v in (("cost", "total_cost"), ("rows", "plan_rows"), ("w_cost", "w_cost"), ("w_rows", "w_rows"))) + " from plan_node group by plan_id")


@query("plan_channels", "select plan_id, cost, rows, w_cost, w_rows from channels")
def _(spark, sf_dir):
    return plan_channels(nodes_of(spark, sf_dir))


def pair_features(pairs: DataFrame, mode: str) -> Column:
    """Of arrays a and b: concat, difference, relative difference, or symmetric relative difference; 0 where the divisor is."""
    zip_ = lambda f: F.zip_with("a", "b", f)
    if mode == "joined":
        return F.concat("a", "b")
    if mode == "difference":
        return zip_(lambda x, y: x - y)
    if mode == "relative":
        return zip_(lambda x, y: F.round(F.when(x != 0, (x - y) / x).otherwise(0.0), 6))
    return zip_(lambda x, y: F.round(F.when(x + y != 0, (x - y) / (x + y)).otherwise(0.0), 6))


def plan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, a, b: each plan's channels with those of the plan five ids on, of the same shape."""
    own = plan_channels(nodes_of(spark, sf_dir)).select("plan_id", F.col("cost").alias("a"))
    return own.join(own.select((F.col("plan_id") - 5).alias("plan_id"), F.col("a").alias("b")), "plan_id")


frame("plan_pairs", "select x.plan_id, x.cost as a, y.cost as b from channels x join channels y on y.plan_id = x.plan_id + 5")


@query("plan_pair_features", "select plan_id, list_transform(range(1, 18), lambda i: a[i] - b[i]) as difference, list_transform(range(1, 18), lambda i: round(case when a[i] <> 0 then (a[i] - b[i]) / a[i] else 0.0 end, 6)) as relative, list_transform(range(1, 18), lambda i: round(case when a[i] + b[i] <> 0 then (a[i] - b[i]) / (a[i] + b[i]) else 0.0 end, 6)) as balanced, list_concat(a, b) as joined from plan_pairs")
def _(spark, sf_dir):
    pairs = plan_pairs(spark, sf_dir)
    return pairs.select("plan_id", *[pair_features(pairs, m).alias(m) for m in ("difference", "relative", "balanced", "joined")])


def pair_labels(pairs: DataFrame) -> DataFrame:
    """ratio, gain and class of costs before and after."""
    ratio = F.col("after") / F.col("before")
    return pairs.select("plan_id", F.round(ratio, 6).alias("ratio"), F.round(1 - ratio, 6).alias("gain"), (1 - ratio > 0.2).cast("int").alias("better"))


@query("pair_labels", "select x.plan_id, round(y.actual_cost / x.actual_cost, 6) as ratio, round(1 - y.actual_cost / x.actual_cost, 6) as gain, (1 - y.actual_cost / x.actual_cost > 0.2)::int as better from plan_log x join plan_log y on y.plan_id = x.plan_id + 5")
def _(spark, sf_dir):
    log = plan_log(spark, sf_dir)
    pairs = log.select("plan_id", F.col("actual_cost").alias("before")).join(log.select((F.col("plan_id") - 5).alias("plan_id"), F.col("actual_cost").alias("after")), "plan_id")
    return pair_labels(pairs)


def index_operator_features(nodes: DataFrame, indexes: DataFrame, stats: DataFrame) -> DataFrame:
    """plan_id, node_id, index_id, col, 12 numbers: join, sort, group, equal scan, range scan; ln rows of the plan and the table, nulls, distinct share; single, several, place.

    A node's column references are exploded once, then meet index columns in an equi-join.
    """
    said = nodes.withColumn("_text", F.concat_ws(" ", "cond", "sort_key")).where("_text != ''")
    refs = said.select("plan_id", "node_id", "node_type", "plan_rows", "cond", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit("([a-z]+_[a-z]+)"), 1))).alias("col"))
    columns = indexes.select("index_id", "tab", "width", F.posexplode("cols").alias("_pos", "col"))
    met = refs.join(columns, "col").join(F.broadcast(stats.select("tab", "col", "rows", "null_frac", "dist_frac")), ["tab", "col"])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    scan, equal = F.col("node_type").isin(*SCANS), F.contains("cond", F.concat("col", F.lit(" = ")))
    vector = F.array(
        flag(F.col("node_type").isin(*JOINS)), flag(F.col("node_type") == "Sort"), flag(F.col("node_type") == "Aggregate"), flag(scan & equal), flag(scan & ~equal), F.round(F.ln(F.col("plan_rows") + 1), 6), F.round(F.ln(F.col("rows") + 1.0), 6),
        F.col("null_frac").cast("double"), F.col("dist_frac").cast("double"), flag(F.col("width") == 1), flag(F.col("width") > 1), (F.col("_pos") + 1).cast("double"),
    )
    return met.select("plan_id", "node_id", "index_id", "col", vector.alias("features"))


frame(
    "op_features",
    f"""
    select plan_id, node_id, index_id, col, [(node_type in {tuple(JOINS)})::int::double, (node_type = 'Sort')::int::double, (node_type = 'Aggregate')::int::double, (node_type in {tuple(SCANS)} and contains(cond, col || ' = '))::int::double,
      (node_type in {tuple(SCANS)} and not contains(cond, col || ' = '))::int::double, round(ln(plan_rows + 1), 6), round(ln(rows + 1), 6), null_frac, dist_frac, (width = 1)::int::double, (width > 1)::int::double, list_position(cols, col)::double] as features
    from (select distinct plan_id, node_id, node_type, plan_rows, cond, unnest(regexp_extract_all(cond || ' ' || sort_key, '([a-z]+_[a-z]+)', 1)) as col from plan_node)
    join (select index_id, tab, cols, i.width, unnest(cols) as col from indexes i) using (col) join (select tab, col, rows, null_frac, dist_frac from column_stats) using (tab, col)""",
)


def op_features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.candidates import indexes_of
    from ..operators.profile import all_stats

    return index_operator_features(nodes_of(spark, sf_dir), indexes_of(spark, sf_dir), all_stats(spark, sf_dir))


@query("index_operator_features", "select plan_id, node_id, index_id, col, features from op_features")
def _(spark, sf_dir):
    return op_features_of(spark, sf_dir)


def pad_and_mask(features: DataFrame, keys: list[str], batch: str, width: int = 12) -> DataFrame:
    """keys, rows (padded with zero vectors to the batch's longest), mask."""
    lists = features.groupBy(*keys, batch).agg(F.array_sort(F.collect_list(F.struct("node_id", "col", "features"))).alias("_l")).withColumn("_l", F.transform("_l", lambda x: x["features"]))
    longest = lists.groupBy(batch).agg(F.max(F.size("_l")).alias("_most"))
    gap = F.col("_most") - F.size("_l")
    zero = F.array_repeat(F.lit(0.0), width)
    padded = lists.join(F.broadcast(longest), batch)
    return padded.select(*keys, F.concat("_l", F.array_repeat(zero, gap)).alias("rows"), F.concat(F.array_repeat(F.lit(1), F.size("_l")), F.array_repeat(F.lit(0), gap)).alias("mask"))


@query("pad_and_mask", "select plan_id, index_id, real, longest - real as padding from (select *, max(real) over (partition by index_id) as longest from (select plan_id, index_id, count(*) as real from op_features group by plan_id, index_id))")
def _(spark, sf_dir):
    return padded_sizes(op_features_of(spark, sf_dir))


def padded_sizes(wanted: DataFrame) -> DataFrame:
    padded = pad_and_mask(wanted.withColumn("_batch", F.col("index_id")), ["plan_id", "index_id"], "_batch")
    ones = F.size(F.filter("mask", lambda m: m == 1))
    return padded.select("plan_id", "index_id", ones.cast("long").alias("real"), (F.size("rows") - ones).cast("long").alias("padding"))


def query_shapes(nodes: DataFrame) -> DataFrame:
    """plan_id, leaf_id, shape: the distinct operator types from a leaf up to, and without, the root."""
    inner = nodes.select("plan_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.join(inner, ["plan_id", "node_id"], "left_anti").select("plan_id", F.col("node_id").alias("leaf_id"), F.explode(F.concat(F.array("node_id"), F.reverse("ancestors"))).alias("node_id"), "depth")
    types = nodes.select("plan_id", "node_id", "node_type")
    steps = leaves.join(types, ["plan_id", "node_id"]).where("node_id > 0 or depth = 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("node_id")).alias("i"), "node_type"))), lambda x: x["node_type"])
    return steps.groupBy("plan_id", "leaf_id").agg(F.array_join(F.array_distinct(ordered), ">").alias("shape"))


@query(
    "query_shapes",
    "select plan_id, leaf_id, string_agg(node_type, '>' order by node_id desc) as shape from (select l.plan_id, l.node_id as leaf_id, m.node_type, max(m.node_id) as node_id from plan_node l join plan_node m on l.leaf and m.plan_id = l.plan_id and starts_with(l.path, m.path) and (m.node_id > 0 or l.depth = 0) group by l.plan_id, l.node_id, m.node_type) group by plan_id, leaf_id",
)
def _(spark, sf_dir):
    return query_shapes(nodes_of(spark, sf_dir))


RULES = ["order-by", "group-by", "join", "selection"]


def index_shapes(indexes: DataFrame, roles: DataFrame, compared: DataFrame) -> DataFrame:
    """query_id, index_id, shape: for each column the first of order-by, group-by, join, selection that it has in the query; '-' for none."""
    kinds = roles.select("query_id", "tab", "col", F.when(F.col("role") == "order_by", 0).when(F.col("role") == "group_by", 1).when((F.col("role") == "predicates") & (F.col("pos") < 2000), 2).alias("k"))
    kinds = kinds.union(compared.select("query_id", "tab", "col", F.lit(3))).where("k is not null").groupBy("query_id", "tab", "col").agg(F.min("k").alias("k"))
    each = indexes.select("query_id", "index_id", "tab", F.posexplode("cols").alias("_pos", "col")).join(kinds, ["query_id", "tab", "col"], "left")
    name = F.lit("-")
    for i, rule in enumerate(RULES):
        name = F.when(F.col("k") == i, rule).otherwise(name)
    return each.groupBy("query_id", "index_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", name.alias("n")))), lambda x: x["n"]), ",").alias("shape"))


frame("first_role", "select query_id, tab, col, min(k) as k from (select query_id, tab, col, case when role = 'order_by' then 0 when role = 'group_by' then 1 when role = 'predicates' and pos < 2000 then 2 end as k from clause_column union all select query_id, tab, col, 3 from literals) where k is not null group by query_id, tab, col")


frame("index_shape", f"select query_id, index_id, string_agg(coalesce(list_extract({RULES}, k + 1), '-'), ',' order by pos) as shape from (select query_id, index_id, tab, unnest(cols) as col, unnest(range(len(cols))) as pos from candidate) left join first_role using (query_id, tab, col) group by query_id, index_id")


@query("index_shapes", "select * from index_shape")
def _(spark, sf_dir):
    from ..operators.candidates import candidates_of
    from ..operators.cost import literals_of
    from ..operators.querylog import roles_of

    return index_shapes(candidates_of(spark, sf_dir), roles_of(spark, sf_dir), literals_of(spark, sf_dir))


def operator_selectivities(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """plan_id, node_type, most: the largest selectivity of scans (rows over the table's) and of joins (rows over the product of the inputs), and density of sorts and groups (rows over input)."""
    child = nodes.where("parent_id >= 0").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.exp(F.sum(F.ln("plan_rows"))).alias("_in"))
    met = nodes.join(F.broadcast(rows.withColumnRenamed("tab", "relation")), "relation", "left").join(child, ["plan_id", "node_id"], "left")
    s = F.when(F.col("node_type").isin(*SCANS), F.col("plan_rows") / F.col("rows")).when(F.col("node_type").isin(*JOINS, "Sort", "Aggregate"), F.col("plan_rows") / F.col("_in"))
    return met.withColumn("_s", s).where("_s is not null").groupBy("plan_id", "node_type").agg(rounded(F.max("_s"), 6).alias("most"))


frame(
    "op_sel",
    f"""
    select n.plan_id, n.node_type, round(max(case when n.node_type in {tuple(SCANS)} then n.plan_rows / t.rows else n.plan_rows / c.inputs end), 6) as most from plan_node n left join (select distinct tab, rows from catalog) t on t.tab = n.relation
    left join (select plan_id, parent_id, exp(sum(ln(plan_rows))) as inputs from plan_node where parent_id >= 0 group by plan_id, parent_id) c on c.plan_id = n.plan_id and c.parent_id = n.node_id
    where n.node_type in {(*SCANS, *JOINS, "Sort", "Aggregate")} group by n.plan_id, n.node_type having max(case when n.node_type in {tuple(SCANS)} then n.plan_rows / t.rows else n.plan_rows / c.inputs end) is not null""",
)


@query("operator_selectivities", "select * from op_sel")
def _(spark, sf_dir):
    from ..operators.cost import table_rows

    return operator_selectivities(nodes_of(spark, sf_dir), table_rows(spark, sf_dir))


#: Leaves and steps of a shape that a filter's vector has room for.
SHAPE_LEAVES, SHAPE_STEPS = 6, 7


def filter_feature_vector(shapes: DataFrame, selectivities: DataFrame) -> DataFrame:
    """plan_id, features: 6 x 7 codes of the leaves' shapes, then the 10 operators' largest selectivities."""
    codes = F.create_map(*[F.lit(x) for i, t in enumerate(CHANNEL_TYPES) for x in (t, float(i + 1))])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    step = F.slice(F.concat(F.transform(F.split("shape", ">"), lambda t: F.coalesce(codes[t], F.lit(0.0))), zeros(SHAPE_STEPS)), 1, SHAPE_STEPS)
    coded = shapes.select("plan_id", "leaf_id", step.alias("_v")).groupBy("plan_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("leaf_id", "_v"))), lambda x: x["_v"])).alias("_v"))
    room = SHAPE_LEAVES * SHAPE_STEPS
    wide = selectivities.groupBy("plan_id").agg(*[F.coalesce(F.max(F.when(F.col("node_type") == t, F.col("most"))), F.lit(0.0)).alias(f"_o{i}") for i, t in enumerate(FILTER_TYPES)])
    return coded.join(wide, "plan_id").select("plan_id", F.concat(F.slice(F.concat("_v", zeros(room)), 1, room), F.array(*[F.col(f"_o{i}") for i in range(len(FILTER_TYPES))])).alias("features"))


frame(
    "shape_vector",
    f"""
select plan_id, list_concat(list_slice(list_concat(v, list_transform(range(42), lambda i: 0.0::double)), 1, 42), o) as features from (
  select plan_id, flatten(list(codes order by leaf_id)) as v from (select plan_id, leaf_id, list_slice(list_concat(list(coalesce(list_position({CHANNEL_TYPES}, node_type), 0)::double order by node_id desc), list_transform(range(7), lambda i: 0.0::double)), 1, 7) as codes
    from (select l.plan_id, l.node_id as leaf_id, m.node_type, max(m.node_id) as node_id from plan_node l join plan_node m on l.leaf and m.plan_id = l.plan_id and starts_with(l.path, m.path) and (m.node_id > 0 or l.depth = 0) group by l.plan_id, l.node_id, m.node_type) group by plan_id, leaf_id) group by plan_id)
join (select plan_id, [{', '.join(f"coalesce(max(most) filter (node_type = '{t}'), 0.0)" for t in FILTER_TYPES)}] as o from op_sel group by plan_id) using (plan_id)""",
)


#: The codes of a column's place in a query, and columns of an index that a vector has room for.
PLACES, PLACE_COLUMNS = {"order-by": 1, "group-by": 2, "selection": 3, "join": 4}, 2


def index_filter_vectors(vectors: DataFrame, utility: DataFrame, shapes: DataFrame, indexes: DataFrame) -> DataFrame:
    """plan_id, index_id, features: utility, 42 codes of the plan's leaves, 2 of the index's columns, 10 selectivities: 55 numbers.

    vectors: plan_id, features as filter_feature_vector gives them. utility: plan_id, col, utility; an index has the
    sum over its columns, 0 where the plan has none. shapes: query_id, index_id, shape; a column without a place has 0.
    """
    codes = F.create_map(*[F.lit(x) for place, code in PLACES.items() for x in (place, float(code))])
    zeros = F.array_repeat(F.lit(0.0), PLACE_COLUMNS)
    coded = F.transform(F.split("shape", ","), lambda p: F.coalesce(codes[p], F.lit(0.0)))
    placed = shapes.select(F.col("query_id").alias("plan_id"), "index_id", F.slice(F.concat(coded, zeros), 1, PLACE_COLUMNS).alias("_p"))
    each = indexes.select("index_id", F.explode("cols").alias("col"))
    gains = placed.select("plan_id", "index_id").join(each, "index_id").join(utility, ["plan_id", "col"]).groupBy("plan_id", "index_id").agg(F.sum("utility").alias("_u"))
    met = placed.join(gains, ["plan_id", "index_id"], "left").join(vectors, "plan_id")
    room = SHAPE_LEAVES * SHAPE_STEPS
    whole = F.concat(F.array(rounded(F.coalesce("_u", F.lit(0.0)), 6)), F.slice("features", 1, room), F.col("_p"), F.slice("features", room + 1, len(FILTER_TYPES)))
    return met.select("plan_id", "index_id", whole.alias("features"))


def filter_vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.candidates import candidates_of, indexes_of
    from ..operators.cost import literals_of, table_rows
    from ..operators.querylog import roles_of

    nodes, rows = nodes_of(spark, sf_dir), table_rows(spark, sf_dir)
    vectors = filter_feature_vector(query_shapes(nodes), operator_selectivities(nodes, rows))
    shapes = index_shapes(candidates_of(spark, sf_dir), roles_of(spark, sf_dir), literals_of(spark, sf_dir))
    return index_filter_vectors(vectors, plan_utility(nodes, rows), shapes, indexes_of(spark, sf_dir))


@query(
    "filter_feature_vector",
    f"""
select s.query_id as plan_id, s.index_id, list_concat(list_concat([round(coalesce(u.g, 0.0), 6)], list_slice(v.features, 1, 42)), list_concat(list_slice(list_concat(list_transform(string_split(s.shape, ','), lambda p: coalesce(list_position({list(PLACES)}, p), 0)::double), [0.0::double, 0.0::double]), 1, 2), list_slice(v.features, 43, 52))) as features
from index_shape s join shape_vector v on v.plan_id = s.query_id left join (
  select c.query_id, c.index_id, sum(x.utility) as g from (select query_id, index_id, unnest(cols) as col from candidate) c join column_utility x on x.plan_id = c.query_id and x.col = c.col group by c.query_id, c.index_id) u
  on u.query_id = s.query_id and u.index_id = s.index_id""",
)
def _(spark, sf_dir):
    """The 55 numbers of each plan and candidate index."""
    return filter_vectors_of(spark, sf_dir)


@query("filter_training_rows", "select query_id, index_id, round(1 - with_cost / without, 6) as label from single_cost where without > 0 and with_cost < without and not contains(index_id, ',')")
def _(spark, sf_dir):
    from ..operators.cost import singles_of

    return filter_training_rows(singles_of(spark, sf_dir))


def filter_training_rows(singles: DataFrame) -> DataFrame:
    """query_id, index_id, label: records with a gain, of single columns; each (query, index) once."""
    rows = singles.where("without > 0 and with_cost < without and not contains(index_id, ',')")
    return rows.dropDuplicates(["query_id", "index_id"]).select("query_id", "index_id", F.round(1 - F.col("with_cost") / F.col("without"), 6).alias("label"))


def operator_terms(nodes: DataFrame) -> DataFrame:
    """plan_id, node_id, term: type, relation and condition of interesting nodes, without blanks, brackets, digits and quoted text."""
    text = F.concat_ws("_", F.replace(F.col("node_type"), F.lit(" "), F.lit("")), "relation", "index_name", "cond", "sort_key")
    clean = F.regexp_replace(F.regexp_replace(text, "'[^']*'", ""), r"[ ()\[\]0-9]|::text", "")
    return nodes.where(F.col("node_type").isin(*INTERESTING)).select("plan_id", "node_id", clean.alias("term"))


frame("op_terms", f"select plan_id, node_id, regexp_replace(regexp_replace(replace(node_type, ' ', '') || '_' || relation || '_' || index_name || '_' || cond || '_' || sort_key, '''[^'']*''', '', 'g'), '[ ()\\[\\]0-9]|::text', '', 'g') as term from plan_node where node_type in {tuple(INTERESTING)}")
frame("op_counts", "select plan_id, term, count(*) as n from op_terms group by plan_id, term")


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("plan_id", "term").agg(F.count("*").alias("n"))


@query("bag_of_operators", "select plan_id, string_agg(term, ' ' order by node_id) as bag from op_terms group by plan_id")
def _(spark, sf_dir):
    return operator_terms(nodes_of(spark, sf_dir)).groupBy("plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "term"))), lambda x: x["term"]), " ").alias("bag"))


@query("operator_bow", "select * from op_counts")
def _(spark, sf_dir):
    return term_counts(operator_terms(nodes_of(spark, sf_dir)))


@query("operator_tfidf", tfidf_sql("op_counts", "plan_id"))
def _(spark, sf_dir):
    return tfidf(term_counts(operator_terms(nodes_of(spark, sf_dir))), "plan_id")


@query("operator_lsi")
def _(spark, sf_dir):
    return term_space(tfidf(term_counts(operator_terms(nodes_of(spark, sf_dir))), "plan_id"), "plan_id", 4)


def exclusive_operators(counts: DataFrame) -> DataFrame:
    """plan_id, own_terms: how many terms no other plan has; 0 for those whose removal loses none."""
    owners = counts.groupBy("term").agg(F.count("*").alias("_o"), F.min("plan_id").alias("plan_id")).where("_o = 1")
    return counts.select("plan_id").distinct().join(owners.groupBy("plan_id").agg(F.count("*").alias("n")), "plan_id", "left").select("plan_id", F.coalesce("n", F.lit(0)).alias("own_terms"))


@query("exclusive_operators", "select plan_id, coalesce(n, 0) as own_terms from (select distinct plan_id from op_counts) left join (select plan_id, count(*) as n from (select min(plan_id) as plan_id from op_counts group by term having count(*) = 1) group by plan_id) using (plan_id)")
def _(spark, sf_dir):
    return exclusive_operators(term_counts(operator_terms(nodes_of(spark, sf_dir))))


def best_removal_sample(counts: DataFrame, samples: int, share: int) -> DataFrame:
    """sample, terms: of keyed subsets that leave out a share (in hundredths) of the plans, the one that keeps most terms."""
    s = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    kept = counts.select("plan_id", "term", s).where((F.col("plan_id") * 7919 + F.col("sample") * 104729) % 100 >= share)
    sizes = kept.select("sample", "term").distinct().groupBy("sample").agg(F.count("*").alias("terms"))
    return sizes.agg(F.max_by("sample", F.struct("terms", -F.col("sample"))).alias("sample"), F.max("terms").alias("terms"))


@query("best_removal_sample", "select sample::int as sample, terms from (select sample, count(distinct term) as terms from op_counts cross join range(0, 8) r(sample) where (plan_id * 7919 + sample * 104729) % 100 >= 30 group by sample) order by terms desc, sample limit 1")
def _(spark, sf_dir):
    return best_removal_sample(term_counts(operator_terms(nodes_of(spark, sf_dir))), 8, 30)


def encode_filters(nodes: DataFrame, stats: DataFrame, kinds: list[str] = ["<", "=", ">"]) -> DataFrame:
    """plan_id, node_id, place, col, op (its code, 0 for NA), value (min-max of the column). Conditions are split at AND and OR."""
    parts = F.split(F.regexp_replace("cond", r"[()]", ""), r"(?i) and | or ")
    each = nodes.where("cond != '' and relation != ''").select("plan_id", "node_id", F.posexplode(parts).alias("place", "_p"))
    found = each.select("plan_id", "node_id", "place", F.regexp_extract("_p", r"^(\w+) ", 1).alias("col"), F.regexp_extract("_p", r" (<=|>=|<>|=|<|>) ", 1).alias("_op"), F.regexp_extract("_p", r" ([-0-9.]+)$", 1).try_cast("double").alias("_v"))
    scaled = (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return found.join(F.broadcast(stats.select("col", "lo", "hi")), "col").select("plan_id", "node_id", "place", "col", F.array_position(F.array(*map(F.lit, kinds)), F.col("_op")).cast("int").alias("op"), F.round(F.when(F.col("hi") > F.col("lo"), scaled).otherwise(0.0), 6).alias("value"))


@query("encode_filters", "select plan_id, node_id, 0 as place, f.col, coalesce(list_position(['<', '=', '>'], op), 0)::int as op, round(case when hi > lo then (v - lo) / (hi - lo) else 0.0 end, 6) as value from (select plan_id, node_id, regexp_extract(c, '^(\\w+) ', 1) as col, regexp_extract(c, ' (<=|>=|<>|=|<|>) ', 1) as op, try_cast(regexp_extract(c, ' ([-0-9.]+)$', 1) as double) as v from (select plan_id, node_id, regexp_replace(cond, '[()]', '', 'g') as c from plan_node where cond != '' and relation != '')) f join column_stats s on s.col = f.col")
def _(spark, sf_dir):
    from ..operators.profile import all_stats

    return encode_filters(nodes_of(spark, sf_dir), all_stats(spark, sf_dir))


def encode_join(nodes: DataFrame) -> DataFrame:
    """plan_id, node_id, join_key: the two sides in order, or none."""
    sides = F.sort_array(F.split(F.regexp_replace("cond", r"[()]", ""), " = "))
    return nodes.select("plan_id", "node_id", F.when(F.col("node_type").isin(*JOINS) & (F.size(sides) == 2), F.array_join(sides, " = ")).otherwise("none").alias("join_key"))


@query("encode_join", f"select plan_id, node_id, case when node_type in {tuple(JOINS)} and contains(cond, ' = ') then array_to_string(list_sort(string_split(regexp_replace(cond, '[()]', '', 'g'), ' = ')), ' = ') else 'none' end as join_key from plan_node")
def _(spark, sf_dir):
    return encode_join(nodes_of(spark, sf_dir))


@query("bfs_order", "select plan_id, node_id, (row_number() over (partition by plan_id order by depth, node_id) - 1)::int as bfs_id, height - 1 as leaf_height from plan_node")
def _(spark, sf_dir):
    at = Window.partitionBy("plan_id").orderBy("depth", "node_id")
    return nodes_of(spark, sf_dir).select("plan_id", "node_id", (F.row_number().over(at) - 1).alias("bfs_id"), (F.col("height") - 1).alias("leaf_height"))


@query("plan_edges", "select plan_id, parent_id, node_id as child_id from plan_node where parent_id >= 0")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).where("parent_id >= 0").select("plan_id", "parent_id", F.col("node_id").alias("child_id"))


def plan_distances(nodes: DataFrame) -> DataFrame:
    """plan_id, a, b, distance: from each ancestor down to its descendants; pairs that are not listed are UNREACHABLE."""
    return nodes.select("plan_id", F.posexplode("ancestors").alias("_k", "a"), F.col("node_id").alias("b"), "depth").select("plan_id", "a", "b", (F.col("depth") - F.col("_k")).alias("distance"))


@query("plan_distances", "select d.plan_id, a.node_id as a, d.node_id as b, d.depth - a.depth as distance from plan_node d join plan_node a on a.plan_id = d.plan_id and a.path <> d.path and starts_with(d.path, a.path)")
def _(spark, sf_dir):
    return plan_distances(nodes_of(spark, sf_dir))


@query("index_usage", "select index_name, count(*) as uses, round(sum(total_cost), 2) as cost, round(sum(plan_rows), 2) as rows from plan_node where starts_with(node_type, 'Index') group by index_name")
def _(spark, sf_dir):
    return nodes_of(spark, sf_dir).where(F.col("node_type").startswith("Index")).groupBy("index_name").agg(F.count("*").alias("uses"), F.round(F.sum("total_cost"), 2).alias("cost"), F.round(F.sum("plan_rows"), 2).alias("rows"))


def table_selectivity(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """plan_id, tab, selectivity: the least rows that a plan reads of a table over the table's, 1 at the most and for empty tables."""
    least = nodes.where("relation != ''").groupBy("plan_id", F.col("relation").alias("tab")).agg(F.min("plan_rows").alias("_read"))
    return least.join(F.broadcast(rows), "tab").select("plan_id", "tab", rounded(F.when(F.col("rows") > 0, F.least(F.lit(1.0), F.col("_read") / F.col("rows"))).otherwise(1.0), 6).alias("selectivity"))


frame("read_share", "select plan_id, tab, round(least(1.0, least_read / rows), 6) as selectivity from (select plan_id, relation as tab, min(plan_rows) as least_read from plan_node where relation != '' group by plan_id, relation) join (select distinct tab, rows from catalog) using (tab)")


@query("table_selectivity_per_query", "select * from read_share")
def _(spark, sf_dir):
    from ..operators.cost import table_rows

    return table_selectivity(nodes_of(spark, sf_dir), table_rows(spark, sf_dir))


def plan_utility(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """plan_id, col, utility: over scans with a condition on the column (1 - s) * cost, over joins on it (1 - sqrt(rows / product of inputs)) * the join's cost, divided by the root's cost."""
    root = nodes.where("node_id = 0").select("plan_id", F.col("total_cost").alias("_root"))
    child = nodes.where("parent_id >= 0").groupBy("plan_id", F.col("parent_id").alias("node_id")).agg(F.exp(F.sum(F.ln("plan_rows"))).alias("_in"))
    met = nodes.where("cond != ''").join(F.broadcast(rows.withColumnRenamed("tab", "relation")), "relation", "left").join(child, ["plan_id", "node_id"], "left")
    columns = F.array_distinct(F.regexp_extract_all("cond", F.lit("([a-z]+_[a-z]+)"), 1))
    scan = 1 - F.pow(1 - F.least(F.lit(1.0), F.col("plan_rows") / F.col("rows")), 1.0 / F.size("_c"))
    s = F.when(F.col("node_type").isin(*SCANS), scan).otherwise(F.least(F.lit(1.0), F.sqrt(F.col("plan_rows") / F.col("_in"))))
    gains = met.withColumn("_c", columns).withColumn("_g", (1 - s) * F.col("total_cost")).where("_g is not null").select("plan_id", F.explode("_c").alias("col"), "_g")
    return gains.groupBy("plan_id", "col").agg(F.sum("_g").alias("_g")).join(root, "plan_id").select("plan_id", "col", rounded(F.col("_g") / F.col("_root"), 6).alias("utility"))


frame(
    "column_utility",
    f"""
select g.plan_id, g.col, round(sum(g.gain) / any_value(r.total_cost), 6) as utility from (
  select n.plan_id, unnest(list_distinct(regexp_extract_all(cond, '([a-z]+_[a-z]+)', 1))) as col,
    (1 - case when node_type in {tuple(SCANS)} then 1 - pow(1 - least(1.0, plan_rows / rows), 1.0 / len(list_distinct(regexp_extract_all(cond, '([a-z]+_[a-z]+)', 1)))) else least(1.0, sqrt(plan_rows / inputs)) end) * total_cost as gain
  from plan_node n left join (select distinct tab, rows from catalog) t on t.tab = n.relation left join (select plan_id, parent_id, exp(sum(ln(plan_rows))) as inputs from plan_node where parent_id >= 0 group by plan_id, parent_id) c on c.plan_id = n.plan_id and c.parent_id = n.node_id where cond != '') g
join (select plan_id, total_cost from plan_node where node_id = 0) r on r.plan_id = g.plan_id where g.gain is not null group by g.plan_id, g.col""",
)


@query("plan_utility", "select * from column_utility")
def _(spark, sf_dir):
    from ..operators.cost import table_rows

    return plan_utility(nodes_of(spark, sf_dir), table_rows(spark, sf_dir))


@query("plan_node_features", f"select plan_id, node_id, [coalesce(list_position({CHANNEL_TYPES}, node_type), 0)::double, (node_type in {tuple(JOINS)})::int::double, (relation != '' and cond != '')::int::double, coalesce(list_position(['customer', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier'], relation), 0)::double] as features from plan_node")
def _(spark, sf_dir):
    """Type, whether it joins, whether it filters, and table, as codes."""
    code = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("double")
    tables = ["customer", "lineitem", "nation", "orders", "part", "region", "supplier"]
    filters = ((F.col("relation") != "") & (F.col("cond") != "")).cast("double")
    return nodes_of(spark, sf_dir).select("plan_id", "node_id", F.array(code("node_type", CHANNEL_TYPES), F.col("node_type").isin(*JOINS).cast("double"), filters, code("relation", tables)).alias("features"))
