"""Costs and benefits over queries and configurations.

A configuration is a set of indexes, its key their ids sorted and joined by `;`. Costs come from the
statistics of the columns (ours, since the logs hold none): a table costs its rows, or by an index
whose leading column has a predicate log2(rows + 1) + 2 * selectivity * rows, whichever is less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from ..sources.adapters import derived
from ..sources.twins import frame
from .candidates import candidates_of, index_combinations, roles_of, shown, sized_of, subsumed_pairs
from .profile import all_stats
from .querylog import columns_of, prepared, typed

COMPARED = ("=", "!=", "<", ">", "<=", ">=")


def literals(tokens: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, tab, col, op, literal: comparisons of a column with a value in the where clause."""
    at = Window.partitionBy("query_id", "ord").orderBy("pos")
    near = tokens.where("clause = 'where'").withColumn("_op", F.lead("token", 1).over(at)).withColumn("literal", F.lead("token", 2).over(at)).withColumn("_t", F.lead("type", 2).over(at))
    found = near.where(F.col("type").endswith("#column") & F.col("_op").isin(*COMPARED) & ~F.col("_t").endswith("column"))
    return found.join(F.broadcast(catalog.select("tab", "col")), F.col("token") == F.col("col")).select("query_id", "tab", "col", F.col("_op").alias("op"), F.col("literal").try_cast("double").alias("literal"))


frame(
    "literals",
    f"""
    select query_id, tab, col, op, try_cast(literal as double) as literal from (
      select query_id, token, clause, type as role, lead(token) over w as op, lead(token, 2) over w as literal, lead(type, 2) over w as next_role from typed_tokens window w as (partition by query_id, ord order by pos))
    join catalog on token = col where clause = 'where' and op in {COMPARED} and role like '%#column' and next_role not like '%column'""",
)
frame(
    "kinds",
    """
    select query_id, tab, col, 'J' as kind, pos from clause_column where role = 'predicates' and pos < 2000
    union all select query_id, tab, col, case when op = '=' then 'EQ' else 'R' end, 2000 from literals""",
)


@derived
def literals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literals(typed(spark, sf_dir), adapters.catalog(spark, sf_dir))


@query("query_literals", "select * from literals")
def _(spark, sf_dir):
    return literals_of(spark, sf_dir)


def column_selectivity(found: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, tab, col, eq, sel: 1/ndv for equality, the literal's place in the range else, a third where it has none."""
    s = F.broadcast(stats.select("tab", "col", "ndv", "lo", "hi"))  # a row a column
    place = (F.col("literal") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    part = F.when(F.col("hi") > F.col("lo"), F.when(F.col("op").isin("<", "<="), place).when(F.col("op").isin(">", ">="), 1 - place))
    sel = F.when(F.col("op") == "=", 1.0 / F.greatest("ndv", F.lit(1))).when(F.col("op") == "!=", 1 - 1.0 / F.greatest("ndv", F.lit(1))).otherwise(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)), F.lit(1 / 3)))
    return found.join(s, ["tab", "col"]).groupBy("query_id", "tab", "col").agg(F.max(F.col("op") == "=").alias("eq"), F.min(sel).alias("sel"))


frame(
    "column_sel",
    """
    select query_id, tab, col, bool_or(op = '=') as eq, min(case when op = '=' then 1.0::double / greatest(ndv, 1) when op = '!=' then 1 - 1.0::double / greatest(ndv, 1)
      else coalesce(greatest(0.0::double, least(1.0::double, case when hi > lo then case when op in ('<', '<=') then (literal - lo) / (hi - lo) when op in ('>', '>=') then 1 - (literal - lo) / (hi - lo) end end)), 1.0::double / 3) end) as sel
    from literals join column_stats using (tab, col) group by query_id, tab, col""",
)


def access_costs(candidates: DataFrame, selectivity: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, tab, index_id, icost: a candidate's cost for its query, where its leading column has a predicate. rows: tab, rows, a row a table."""
    parts = candidates.select("query_id", "tab", "index_id", F.posexplode("cols").alias("_pos", "col")).join(selectivity, ["query_id", "tab", "col"])
    lined = parts.groupBy("query_id", "tab", "index_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "eq", "sel"))).alias("_p")).where(F.col("_p")[0]["_pos"] == 0)
    start = F.struct(F.lit(1.0).alias("sel"), F.lit(True).alias("open"), F.lit(0).alias("next"))
    walk = F.aggregate("_p", start, lambda s, p: F.when(s["open"] & (p["_pos"] == s["next"]), F.struct((s["sel"] * p["sel"]).alias("sel"), p["eq"].alias("open"), (s["next"] + 1).alias("next"))).otherwise(F.struct(s["sel"].alias("sel"), F.lit(False).alias("open"), s["next"].alias("next"))), lambda s: s["sel"])
    cost = F.log2(F.col("rows") + 1) + 2 * walk * F.col("rows")
    return lined.join(F.broadcast(rows), "tab").select("query_id", "tab", "index_id", F.round(cost, 4).alias("icost"))


frame(
    "access_cost",
    """
    select c.query_id, c.tab, c.index_id, round(log2(t.rows + 1) + 2 * (a.sel * case when a.eq and b.sel is not null then b.sel else 1.0::double end) * t.rows, 4) as icost
    from candidate c join column_sel a on a.query_id = c.query_id and a.tab = c.tab and a.col = c.cols[1]
    left join column_sel b on b.query_id = c.query_id and b.tab = c.tab and c.width = 2 and b.col = c.cols[2]
    join (select distinct tab, rows from catalog) t on t.tab = c.tab""",
)


def scan_costs(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, tab, scan: the rows of each table that a query touches."""
    return columns.select("query_id", "tab").distinct().join(F.broadcast(rows), "tab").select("query_id", "tab", F.col("rows").cast("double").alias("scan"))


frame("scan_cost", "select distinct query_id, tab, rows::double as scan from query_column join (select distinct tab, rows from catalog) using (tab)")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.catalog(spark, sf_dir).select("tab", "rows").distinct()


@derived
def accesses_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_costs(candidates_of(spark, sf_dir), column_selectivity(literals_of(spark, sf_dir), all_stats(spark, sf_dir)), table_rows(spark, sf_dir))


@derived
def scans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_costs(columns_of(spark, sf_dir), table_rows(spark, sf_dir))


@query("whatif_access", "select * from access_cost")
def _(spark, sf_dir):
    return accesses_of(spark, sf_dir)


def single_costs(scans: DataFrame, accesses: DataFrame) -> DataFrame:
    """query_id, index_id, without, with_cost: each query alone with each of its candidates."""
    total = scans.groupBy("query_id").agg(F.sum("scan").alias("without"))
    return accesses.join(scans, ["query_id", "tab"]).join(total, "query_id").select("query_id", "index_id", F.round("without", 4).alias("without"), F.round(F.col("without") - F.col("scan") + F.least("scan", "icost"), 4).alias("with_cost"))


frame("single_cost", "select a.query_id, a.index_id, round(w.without, 4) as without, round(w.without - s.scan + least(s.scan, a.icost), 4) as with_cost from access_cost a join scan_cost s on a.query_id = s.query_id and a.tab = s.tab join (select query_id, sum(scan) as without from scan_cost group by query_id) w on w.query_id = a.query_id")


@derived
def singles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_costs(scans_of(spark, sf_dir), accesses_of(spark, sf_dir))


@query("whatif_cost", "select * from single_cost")
def _(spark, sf_dir):
    return singles_of(spark, sf_dir)


#: Configurations that the queries below cost.
CONFIGS = {
    1: ["lineitem#l_quantity"], 2: ["lineitem#l_orderkey", "orders#o_totalprice"], 3: ["customer#c_custkey", "lineitem#l_orderkey,l_linenumber", "orders#o_custkey", "part#p_size"],
    4: ["lineitem#l_quantity", "lineitem#l_quantity,l_shipdate", "supplier#s_acctbal"], 5: ["part#p_size,p_retailprice", "orders#o_totalprice", "lineitem#l_extendedprice"],
}
frame("config_index", "select * from (values " + ", ".join(f"({k}, '{i}')" for k, ids in CONFIGS.items() for i in ids) + ") c(config_id, index_id)")


def config_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i) for k, ids in CONFIGS.items() for i in ids], "config_id int, index_id string")


def config_key(ids: Column) -> Column:
    return F.array_join(F.sort_array(ids), ";")


def relevant_configs(configs: DataFrame, columns: DataFrame) -> DataFrame:
    """query_id, config_id, config_key: a configuration cut to the indexes that share a column with the query; '' where none does."""
    each = configs.select("config_id", "index_id", F.split_part("index_id", F.lit("#"), F.lit(1)).alias("tab"), F.explode(F.split(F.split_part("index_id", F.lit("#"), F.lit(2)), ",")).alias("col"))
    shared = columns.join(F.broadcast(each), ["tab", "col"]).select("query_id", "config_id", "index_id").distinct()  # the configurations under study
    keys = shared.groupBy("query_id", "config_id").agg(config_key(F.collect_list("index_id")).alias("config_key"))
    every = columns.select("query_id").distinct().join(F.broadcast(configs.select("config_id").distinct()))
    return every.join(keys, ["query_id", "config_id"], "left").select("query_id", "config_id", F.coalesce("config_key", F.lit("")).alias("config_key"))


frame(
    "relevant",
    """
    select query_id, config_id, coalesce(string_agg(index_id, ';' order by index_id), '') as config_key from (
      select distinct q.query_id, c.config_id, x.index_id from (select distinct query_id from query_column) q cross join (select distinct config_id from config_index) c
      left join (select distinct qc.query_id, ci.config_id, ci.index_id from query_column qc join config_index ci on split_part(ci.index_id, '#', 1) = qc.tab and list_contains(string_split(split_part(ci.index_id, '#', 2), ','), qc.col)) x on x.query_id = q.query_id and x.config_id = c.config_id)
    group by query_id, config_id""",
)


def relevant_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant_configs(config_index(spark), columns_of(spark, sf_dir))


@query("relevant_config", "select * from relevant")
def _(spark, sf_dir):
    return relevant_of(spark, sf_dir)


@query("cost_requests", "select count(*) as requests, count(distinct (query_id, config_key)) as costed, round(1 - count(distinct (query_id, config_key)) / count(*), 6) as hit_rate from relevant")
def _(spark, sf_dir):
    """How many requests a cache by relevant configuration leaves."""
    each = relevant_of(spark, sf_dir).groupBy("query_id", "config_key").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("requests"), F.count("*").alias("costed"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("hit_rate"))


def config_costs(configs: DataFrame, scans: DataFrame, accesses: DataFrame) -> DataFrame:
    """query_id, config_id, cost, used: each table at its least cost; used are the indexes that win, ties to the first id."""
    hits = accesses.join(F.broadcast(configs), "index_id").groupBy("config_id", "query_id", "tab").agg(F.min(F.struct("icost", F.length("index_id").alias("l"), "index_id")).alias("_m"))
    every = scans.join(F.broadcast(configs.select("config_id").distinct()))
    least = every.join(hits, ["config_id", "query_id", "tab"], "left").withColumn("_win", F.col("_m.icost") < F.col("scan"))
    return least.groupBy("query_id", "config_id").agg(
        F.round(F.sum(F.when(F.col("_win"), F.col("_m.icost")).otherwise(F.col("scan"))), 4).alias("cost"), config_key(F.collect_list(F.when(F.col("_win"), F.col("_m.index_id")))).alias("used")
    )


frame(
    "config_cost",
    """
    select query_id, config_id, round(sum(case when icost < scan then icost else scan end), 4) as cost, coalesce(string_agg(case when icost < scan then index_id end, ';' order by index_id), '') as used from (
      select s.query_id, c.config_id, s.tab, s.scan, m.icost, m.index_id from scan_cost s cross join (select distinct config_id from config_index) c
      left join (select config_id, query_id, tab, icost, index_id from access_cost join config_index using (index_id) qualify row_number() over (partition by config_id, query_id, tab order by icost, len(index_id), index_id) = 1) m
        on m.config_id = c.config_id and m.query_id = s.query_id and m.tab = s.tab)
    group by query_id, config_id""",
)


@derived
def costs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_costs(config_index(spark), scans_of(spark, sf_dir), accesses_of(spark, sf_dir))


@query("config_cost", "select * from config_cost")
def _(spark, sf_dir):
    return costs_of(spark, sf_dir)


@query("workload_cost", "select config_id, round(sum(cost * freq), 2) as cost from config_cost join workload using (query_id) group by config_id")
def _(spark, sf_dir):
    weights = prepared(spark, sf_dir).select("query_id", "freq")
    return costs_of(spark, sf_dir).join(weights, "query_id").groupBy("config_id").agg(F.round(F.sum(F.col("cost") * F.col("freq")), 2).alias("cost"))


@query("workload_cost_no_interaction", "select config_id, round(avg(cost), 2) as cost from (select config_id, index_id, sum(freq * least(scan, coalesce(icost, scan))) as cost from config_index cross join scan_cost join workload using (query_id) left join access_cost using (index_id, query_id, tab) group by config_id, index_id) group by config_id")
def _(spark, sf_dir):
    """The mean over a configuration's indexes, each costed alone."""
    alone = config_index(spark)
    each = scans_of(spark, sf_dir).join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id").join(F.broadcast(alone))
    costed = each.join(accesses_of(spark, sf_dir), ["index_id", "query_id", "tab"], "left").groupBy("config_id", "index_id").agg(F.sum(F.col("freq") * F.least("scan", F.coalesce("icost", "scan"))).alias("cost"))
    return costed.groupBy("config_id").agg(F.round(F.avg("cost"), 2).alias("cost"))


@query("utilized_indexes", "select distinct config_id, unnest(string_split(used, ';')) as index_id from config_cost where used != ''")
def _(spark, sf_dir):
    return costs_of(spark, sf_dir).where("used != ''").select("config_id", F.explode(F.split("used", ";")).alias("index_id")).distinct()


@query("query_details", "select query_id, config_id, without, cost, used from config_cost join (select query_id, sum(scan) as without from scan_cost group by query_id) using (query_id)")
def _(spark, sf_dir):
    return costs_of(spark, sf_dir).join(scans_of(spark, sf_dir).groupBy("query_id").agg(F.sum("scan").alias("without")), "query_id").select("query_id", "config_id", "without", "cost", "used")


def index_benefits(singles: DataFrame, weights: DataFrame) -> DataFrame:
    """index_id, benefit: what it saves over all queries that it helps, summed before the shuffle."""
    gain = singles.where("with_cost < without").join(weights.select("query_id", "freq"), "query_id")
    return gain.groupBy("index_id").agg(F.round(F.sum((F.col("without") - F.col("with_cost")) * F.col("freq")), 2).alias("benefit"))


frame("index_benefits", "select index_id, round(sum((without - with_cost) * freq), 2) as benefit from single_cost join workload using (query_id) where with_cost < without group by index_id")


@derived
def benefits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_benefits(singles_of(spark, sf_dir), prepared(spark, sf_dir))


@query("index_benefit", "select * from index_benefits")
def _(spark, sf_dir):
    return benefits_of(spark, sf_dir)


def ratios(benefits: DataFrame, sized: DataFrame) -> DataFrame:
    """index_id, tab, cols, width, size_bytes, benefit, ratio, place: by benefit per byte, ties by width and columns."""
    both = sized.join(benefits, "index_id").withColumn("ratio", F.round(F.col("benefit") / F.col("size_bytes"), 6))
    return both


def ratio_order() -> list[Column]:
    return [F.desc("ratio"), F.asc("width"), F.asc("index_id")]


frame("ratios", "select index_id, tab, width, size_bytes, benefit, round(benefit / size_bytes, 6) as ratio from index_sizes join index_benefits using (index_id)")


def ratios_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios(benefits_of(spark, sf_dir), sized_of(spark, sf_dir))


@query("benefit_size_ratio", "select index_id, benefit, size_bytes, ratio from ratios")
def _(spark, sf_dir):
    return ratios_of(spark, sf_dir).select("index_id", "benefit", "size_bytes", "ratio")


@query("top_indexes", "select tab, place::int as place, index_id, ratio from (select *, row_number() over (partition by tab order by ratio desc, width, index_id) as place from ratios) where place <= 3")
def _(spark, sf_dir):
    at = Window.partitionBy("tab").orderBy(*ratio_order())
    return ratios_of(spark, sf_dir).withColumn("place", F.row_number().over(at)).where("place <= 3").select("tab", "place", "index_id", "ratio")


def absorb(group):
    """One table and leading column: walked by ratio, an index takes the benefit of later ones that it subsumes and that none has taken."""
    import pandas as pd

    rows = group.sort_values(["ratio", "width", "index_id"], ascending=[False, True, True]).to_dict("records")
    gone: set[str] = set()
    for i, a in enumerate(rows):
        if a["index_id"] in gone:
            continue
        for b in rows[i + 1 :]:
            if b["index_id"] not in gone and a["index_id"].startswith(b["index_id"] + ","):
                a["benefit"] += b["benefit"]
                gone.add(b["index_id"])
    kept = [{"index_id": r["index_id"], "benefit": round(r["benefit"], 2), "size_bytes": r["size_bytes"], "width": r["width"]} for r in rows if r["index_id"] not in gone]
    return pd.DataFrame(kept, columns=["index_id", "benefit", "size_bytes", "width"])


def combine_subsumed(rated: DataFrame) -> DataFrame:
    """index_id, benefit, size_bytes, width, ratio: after higher-ratio indexes have absorbed what they subsume."""
    lead = rated.select("index_id", "benefit", "size_bytes", "width", "ratio", F.split_part("index_id", F.lit(","), F.lit(1)).alias("_lead"))
    done = lead.groupBy("_lead").applyInPandas(lambda g: absorb(g), "index_id string, benefit double, size_bytes long, width int")
    return done.withColumn("ratio", F.round(F.col("benefit") / F.col("size_bytes"), 6))


frame(
    "combined",
    """
select index_id, round(benefit + coalesce(taken, 0), 2) as benefit, size_bytes, width, round(round(benefit + coalesce(taken, 0), 2) / size_bytes, 6) as ratio from ratios
left join (select taker, sum(benefit) as taken from (
  select b.index_id, b.benefit, a.index_id as taker from ratios b join ratios a on starts_with(a.index_id, b.index_id || ',') and (a.ratio > b.ratio)
  qualify row_number() over (partition by b.index_id order by a.ratio desc, a.width, a.index_id) = 1) group by taker) on taker = index_id
where index_id not in (select b.index_id from ratios b join ratios a on starts_with(a.index_id, b.index_id || ',') and a.ratio > b.ratio)""",
)


@query("combine_subsumed", "select * from combined")
def _(spark, sf_dir):
    return combine_subsumed(ratios_of(spark, sf_dir))


MODES = ("default", "cost_size", "negative_cost", "ratio", "benefit")


def selection_scores(rows: DataFrame, mode: str) -> DataFrame:
    """Adds score by mode; rows have cost, benefit, size_bytes. cost_size is in 10^9."""
    score = {"default": F.col("benefit") / F.col("size_bytes"), "cost_size": F.col("cost") * F.col("size_bytes") / 1e9, "negative_cost": -F.col("cost"), "ratio": F.col("benefit") / F.col("size_bytes"), "benefit": F.col("benefit")}
    return rows.withColumn("mode", F.lit(mode)).withColumn("score", F.round(score[mode], 2))


frame("index_totals", "select index_id, size_bytes, benefit, round((select sum(scan * freq) from scan_cost join workload using (query_id)) - benefit, 2) as cost from ratios")


@query("selection_scores", " union all ".join(f"select index_id, '{m}' as mode, round({s}, 2) as score from index_totals" for m, s in (("default", "benefit / size_bytes"), ("cost_size", "cost * size_bytes / 1e9"), ("negative_cost", "-cost"), ("ratio", "benefit / size_bytes"), ("benefit", "benefit"))))
def _(spark, sf_dir):
    base = scans_of(spark, sf_dir).join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id").agg(F.sum(F.col("scan") * F.col("freq")).alias("_base"))
    rows = ratios_of(spark, sf_dir).join(F.broadcast(base)).withColumn("cost", F.round(F.col("_base") - F.col("benefit"), 2))
    found = None
    for m in MODES:
        part = selection_scores(rows, m).select("index_id", "mode", "score")
        found = part if found is None else found.union(part)
    return found


frame("config_totals", "select config_id, sum(cost * freq) as final, sum(without * freq) as initial from config_cost join (select query_id, sum(scan) as without from scan_cost group by query_id) using (query_id) join workload using (query_id) group by config_id")


def totals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    without = scans_of(spark, sf_dir).groupBy("query_id").agg(F.sum("scan").alias("without"))
    rows = costs_of(spark, sf_dir).join(without, "query_id").join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id")
    return rows.groupBy("config_id").agg(F.sum(F.col("cost") * F.col("freq")).alias("final"), F.sum(F.col("without") * F.col("freq")).alias("initial"))


@query("cost_proportion", "select config_id, round(final / initial * 100, 2) as proportion from config_totals")
def _(spark, sf_dir):
    return totals_of(spark, sf_dir).select("config_id", F.round(F.col("final") / F.col("initial") * 100, 2).alias("proportion"))


@query("config_report", "select config_id, query_id, round(sum(without * freq), 2) as no_index, round(sum(cost * freq), 2) as with_index from config_cost join (select query_id, sum(scan) as without from scan_cost group by query_id) using (query_id) join workload using (query_id) group by grouping sets ((config_id, query_id), (config_id))")
def _(spark, sf_dir):
    """Per query, and a total with a null query_id."""
    without = scans_of(spark, sf_dir).groupBy("query_id").agg(F.sum("scan").alias("without"))
    rows = costs_of(spark, sf_dir).join(without, "query_id").join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id")
    rolled = rows.rollup("config_id", "query_id").agg(F.round(F.sum(F.col("without") * F.col("freq")), 2).alias("no_index"), F.round(F.sum(F.col("cost") * F.col("freq")), 2).alias("with_index"))
    return rolled.where("config_id is not null").select("config_id", "query_id", "no_index", "with_index")


def rewards(steps: DataFrame) -> DataFrame:
    """Six rewards a step. steps: episode, step, cost, size_mb; step 0 is the start."""
    at = Window.partitionBy("episode").orderBy("step")
    prev, first, prev_size = F.lag("cost").over(at), F.first("cost").over(at), F.lag("size_mb").over(at)
    w = steps.withColumn("_p", prev).withColumn("_f", first).withColumn("_d", F.col("size_mb") - prev_size).where("_p is not null")
    gain, initial = F.col("_p") - F.col("cost"), F.col("_f") != 0
    safe = lambda x: F.round(F.when(initial, x).otherwise(0.0), 6)
    return w.select(
        "episode", "step", F.round(F.when(F.col("_d") != 0, gain / F.col("_d")), 6).alias("per_size"), F.round(gain, 6).alias("absolute"), safe(gain / F.col("_f")).alias("relative"),
        safe(F.when(F.col("_d") != 0, gain / F.col("_f") / F.col("_d"))).alias("relative_per_mb"), safe((F.col("_f") - F.col("cost")) / F.col("_f") * 100).alias("achieved"), safe((F.col("_f") - F.col("cost")) / F.col("_f") * 100 / F.col("size_mb")).alias("achieved_per_mb"),
    )


frame("steps", "select event_type as episode, row_number() over (partition by event_type order by event_id) - 1 as step, 1000 + value as cost, round(event_id / 100.0, 2)::double + 1 as size_mb from events")


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("event_type").orderBy("event_id")
    return adapters.read(spark, sf_dir, "events").select(F.col("event_type").alias("episode"), (F.row_number().over(at) - 1).cast("long").alias("step"), (F.col("value") + 1000).alias("cost"), (F.round(F.col("event_id") / 100.0, 2) + 1).alias("size_mb"))


@query(
    "reward",
    """
select episode, step, round(case when d <> 0 then (p - cost) / d end, 6) as per_size, round(p - cost, 6) as absolute, round((p - cost) / f, 6) as relative, round(case when d <> 0 then (p - cost) / f / d end, 6) as relative_per_mb,
  round((f - cost) / f * 100, 6) as achieved, round((f - cost) / f * 100 / size_mb, 6) as achieved_per_mb
from (select *, lag(cost) over w as p, first_value(cost) over w as f, size_mb - lag(size_mb) over w as d from steps window w as (partition by episode order by step)) where p is not null""",
)
def _(spark, sf_dir):
    return rewards(steps_of(spark, sf_dir))


frame("single_gain", "select query_id, index_id, without, with_cost from single_cost where with_cost < without")


def useful_combinations(costs: DataFrame, without: DataFrame) -> DataFrame:
    """query_id, config_id, cost: only those that beat no index for the query."""
    return costs.join(without, "query_id").where("cost < without").select("query_id", "config_id", "cost")


@query("useful_combinations", "select query_id, config_id, cost from config_cost join (select query_id, sum(scan) as without from scan_cost group by query_id) using (query_id) where cost < without")
def _(spark, sf_dir):
    return useful_combinations(costs_of(spark, sf_dir), scans_of(spark, sf_dir).groupBy("query_id").agg(F.sum("scan").alias("without")))


@query(
    "cophy_coefficients",
    """
select 'size' as kind, dense::bigint as a, size_bytes::double as value, index_id as name from (select *, row_number() over (order by index_id) as dense from index_sizes)
union all select 'cost', query_id, without, '' from (select query_id, sum(scan) as without from scan_cost group by query_id)
union all select 'cost', query_id, with_cost, index_id from single_gain""",
)
def _(spark, sf_dir):
    """Sizes of the numbered indexes; the costs of each query with no index (name '') and with each that improves it."""
    sized, singles, scans = sized_of(spark, sf_dir), singles_of(spark, sf_dir), scans_of(spark, sf_dir)
    numbered = sized.select(F.lit("size").alias("kind"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("index_id")).cast("long").alias("a"), F.col("size_bytes").cast("double").alias("value"), F.col("index_id").alias("name"))
    base = scans.groupBy("query_id").agg(F.sum("scan").alias("value")).select(F.lit("cost"), "query_id", "value", F.lit(""))
    return numbered.union(base).union(singles.where("with_cost < without").select(F.lit("cost"), "query_id", "with_cost", "index_id"))


def select_benefit_greedy(rated: DataFrame, budget_bytes: int | None = None, count: int | None = None) -> DataFrame:
    """place, index_id, benefit, size_bytes, ratio: in ratio order the first count, or those that fit the budget, a too large one skipped.

    Only the candidates that could matter reach the driver: those of the budget's size at the most, as many as there are
    indexes (bounded by the catalog and the width, not by the log).
    """
    ordered = rated.select("index_id", "benefit", "size_bytes", "ratio", "width")
    if budget_bytes is None:
        top = ordered.orderBy(*ratio_order()).limit(count or 0)
        return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ratio_order())).alias("place"), "index_id", "benefit", "size_bytes", "ratio")
    used, chosen = 0, []
    for r in ordered.where(F.col("size_bytes") <= budget_bytes).orderBy(*ratio_order()).toLocalIterator():
        if used + r["size_bytes"] <= budget_bytes:
            used += r["size_bytes"]
            chosen.append((len(chosen) + 1, r["index_id"], r["benefit"], r["size_bytes"], r["ratio"]))
    return rated.sparkSession.createDataFrame(chosen, "place int, index_id string, benefit double, size_bytes long, ratio double")


@query("select_benefit_greedy", "select row_number() over (order by ratio desc, width, index_id)::int as place, index_id, benefit, size_bytes, ratio from ratios order by ratio desc, width, index_id limit 5")
def _(spark, sf_dir):
    return select_benefit_greedy(ratios_of(spark, sf_dir), count=5)


#: The budget of the flagship query, in bytes.
BUDGET = 500_000


def recommendation(spark: SparkSession, sf_dir: str, budget_bytes: int = BUDGET) -> DataFrame:
    """The flagship: from the log to the indexes that fit a budget."""
    return select_benefit_greedy(combine_subsumed(ratios_of(spark, sf_dir)), budget_bytes)


frame("fitting", f"select *, row_number() over (order by ratio desc, width, index_id) as turn from combined where size_bytes <= {BUDGET}")
frame(
    "filling",
    f"""select 0::bigint as turn, 0::bigint as used, false as taken
    union all select fitting.turn, used + case when used + size_bytes <= {BUDGET} then size_bytes else 0 end, used + size_bytes <= {BUDGET} from filling join fitting on fitting.turn = filling.turn + 1""",
)


@query("recommendation", "select row_number() over (order by turn)::int as place, index_id, benefit, size_bytes, ratio from filling join fitting using (turn) where taken")
def _(spark, sf_dir):
    return recommendation(spark, sf_dir)
