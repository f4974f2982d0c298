"""Rounds of a query log: sightings, windows, drift, online statistics; batch operators and their streaming forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from ..sources.twins import frame

#: Rounds that a query is remembered after its last sighting.
MEMORY = 1


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query (its template and literal's last digit), round_id, ts: one row a sighting."""
    return adapters.query_log(spark, sf_dir).select(F.concat_ws("-", F.col("template_id").cast("string"), (F.length("sql") % 7).cast("string"), (F.col("user_id") % 11).cast("string")).alias("query"), "round_id", "ts", "latency", "freq")


frame("sightings", "select template_id::varchar || '-' || (length(sql) % 7)::varchar || '-' || (user_id % 11)::varchar as query, round_id, ts, latency, freq from query_log")


def query_store(sightings: DataFrame, memory: int = MEMORY) -> DataFrame:
    """query, life, frequency, first_seen, last_seen: a life ends when a query is unseen for more than memory rounds, and its first sighting resets."""
    each = sightings.groupBy("query", "round_id").agg(F.count("*").alias("n"))
    at = Window.partitionBy("query").orderBy("round_id")
    gone = F.coalesce((F.col("round_id") - F.lag("round_id").over(at) > memory).cast("int"), F.lit(0))
    lives = each.withColumn("_gone", gone).withColumn("life", F.sum("_gone").over(at))
    return lives.groupBy("query", "life").agg(F.sum("n").alias("frequency"), F.min("round_id").alias("first_seen"), F.max("round_id").alias("last_seen"))


frame("seen_rounds", "select query, round_id, count(*) as n from sightings group by query, round_id")
frame(
    "lives",
    "select query, round_id, n, sum(gone) over (partition by query order by round_id)::bigint as life from (select *, coalesce((round_id - lag(round_id) over (partition by query order by round_id) > 1)::int, 0) as gone from seen_rounds)",
)


@query("query_store", "select query, life, sum(n)::bigint as frequency, min(round_id) as first_seen, max(round_id) as last_seen from lives group by query, life")
def _(spark, sf_dir):
    return query_store(templated(spark, sf_dir))


def round_windows(arrivals: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """round_start, arrivals, freq: tumbling, or sliding with a slide. Works on streams, with a watermark set before."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return arrivals.groupBy(w.alias("_w")).agg(F.count("*").alias("arrivals"), F.sum("freq").alias("freq")).select(F.col("_w.start").alias("round_start"), "arrivals", "freq")


@query("round_windows", "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01 00:00:00') as round_start, count(*) as arrivals, sum(freq)::bigint as freq from query_log group by 1")
def _(spark, sf_dir):
    return round_windows(adapters.query_log(spark, sf_dir), "6 hours")


@query("round_windows_sliding", "select time_bucket(interval '1 day', ts, timestamp '1970-01-01 00:00:00') - to_days(k::int) as round_start, count(*) as arrivals, sum(freq)::bigint as freq from query_log cross join range(0, 2) r(k) group by 1")
def _(spark, sf_dir):
    return round_windows(adapters.query_log(spark, sf_dir), "2 days", "1 day")


def past_and_new(sightings: DataFrame, memory: int = MEMORY) -> DataFrame:
    """round_id, past, new: queries first seen in the round, and those first seen earlier and seen within memory."""
    each = sightings.select("query", "round_id").distinct()
    at = Window.partitionBy("query").orderBy("round_id")
    lives = each.withColumn("_prev", F.lag("round_id").over(at)).withColumn("_next", F.lead("round_id").over(at))
    fresh = F.col("_prev").isNull() | (F.col("round_id") - F.col("_prev") > memory)
    started = lives.where(fresh).groupBy("round_id").agg(F.count("*").alias("new"))
    # A sighting makes its query a past one in the rounds after it, up to its memory or its next sighting, and in that of its next sighting.
    until = F.least(F.col("round_id") + memory, F.coalesce("_next", F.col("round_id") + memory))
    carried = lives.where(until > F.col("round_id")).select("query", F.explode(F.sequence(F.col("round_id") + 1, until)).alias("round_id"))
    past = carried.groupBy("round_id").agg(F.count("*").alias("past"))
    rounds = sightings.select("round_id").distinct()
    return rounds.join(past, "round_id", "left").join(started, "round_id", "left").select("round_id", F.coalesce("past", F.lit(0)).alias("past"), F.coalesce("new", F.lit(0)).alias("new"))


frame(
    "past_new",
    """
    select round_id, coalesce(past, 0) as past, coalesce(fresh, 0) as new from (select distinct round_id from sightings)
    left join (select r.round_id, count(distinct s.query) as past from (select distinct round_id from sightings) r join seen_rounds s on s.round_id < r.round_id and s.round_id >= r.round_id - 1 group by r.round_id) using (round_id)
    left join (select round_id, count(*) as fresh from (select query, round_id, lag(round_id) over (partition by query order by round_id) as p from seen_rounds) where p is null or round_id - p > 1 group by round_id) using (round_id)""",
)


@query("past_and_new_queries", "select * from past_new")
def _(spark, sf_dir):
    return past_and_new(templated(spark, sf_dir))


def by_round() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("round_id")  # one row a round


def workload_change(rounds: DataFrame) -> DataFrame:
    """round_id, change: the previous round's new queries over this one's past ones; 1 where there are none."""
    added = F.coalesce(F.lag("new").over(by_round()), F.lit(0))
    return rounds.select("round_id", F.round(F.when(F.col("past") > 0, added / F.col("past")).otherwise(1.0), 6).alias("change"))


frame("changes", "select round_id, round(case when past > 0 then coalesce(lag(new) over (order by round_id), 0) / past else 1 end, 6) as change from past_new")


@query("workload_change", "select * from changes")
def _(spark, sf_dir):
    return workload_change(past_and_new(templated(spark, sf_dir)))


def forget_factor(changes: DataFrame) -> DataFrame:
    """round_id, change, factor (0 beyond a half, else 1 - 2 change), reset_exploration (beyond a tenth)."""
    return changes.select("round_id", "change", F.round(F.when(F.col("change") > 0.5, 0.0).otherwise(1 - 2 * F.col("change")), 6).alias("factor"), (F.col("change") > 0.1).alias("reset_exploration"))


@query("forget_factor", "select round_id, change, round(case when change > 0.5 then 0.0 else 1 - 2 * change end, 6) as factor, change > 0.1 as reset_exploration from changes")
def _(spark, sf_dir):
    return forget_factor(workload_change(past_and_new(templated(spark, sf_dir))))


def top_configs(spark: SparkSession, sf_dir: str, size: int = 40) -> DataFrame:
    """round_id, index_id: a round's most frequent queries stand for the indexes chosen in it."""
    counts = templated(spark, sf_dir).groupBy("round_id", F.col("query").alias("index_id")).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("round_id").orderBy(F.desc("n"), "index_id"))).where(f"_r <= {size}").select("round_id", "index_id", "n")


frame("round_config", "select round_id, query as index_id, n from (select round_id, query, n, row_number() over (partition by round_id order by n desc, query) as r from seen_rounds) where r <= 40")


def config_diff(configs: DataFrame) -> DataFrame:
    """round_id, index_id, status against the round before: added, kept, deleted."""
    now, before = configs.select("round_id", "index_id", F.lit(1).alias("_now")), configs.select((F.col("round_id") + 1).alias("round_id"), "index_id", F.lit(1).alias("_before"))
    rounds = configs.agg(F.max("round_id").alias("_last"))
    both = now.join(before, ["round_id", "index_id"], "full_outer").join(F.broadcast(rounds)).where("round_id <= _last")
    return both.select("round_id", "index_id", F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "deleted").otherwise("kept").alias("status"))


@query("config_diff", "select coalesce(a.round_id, b.round_id + 1) as round_id, coalesce(a.index_id, b.index_id) as index_id, case when b.index_id is null then 'added' when a.index_id is null then 'deleted' else 'kept' end as status from round_config a full join round_config b on a.round_id = b.round_id + 1 and a.index_id = b.index_id where coalesce(a.round_id, b.round_id + 1) <= (select max(round_id) from round_config)")
def _(spark, sf_dir):
    return config_diff(top_configs(spark, sf_dir))


def arm_rewards(costs: DataFrame) -> DataFrame:
    """round_id, reward: 1 - cost with / cost without, the same for every chosen arm. costs: round_id, freq, with_cost, without."""
    return costs.groupBy("round_id").agg(F.round(1 - F.sum(F.col("with_cost") * F.col("freq")) / F.sum(F.col("without") * F.col("freq")), 6).alias("reward"))


@query("arm_rewards", "select round_id, round(1 - sum(latency * freq) / sum((latency + 10) * freq), 6) as reward from sightings group by round_id")
def _(spark, sf_dir):
    rows = templated(spark, sf_dir).select("round_id", "freq", F.col("latency").alias("with_cost"), (F.col("latency") + 10).alias("without"))
    return arm_rewards(rows)


def halving_average(plays: DataFrame, key: str, order: str, reward: str) -> DataFrame:
    """key, usage: u = (u + reward) / 2 a play, from 0: a sum of rewards, each halved once a play from its own on."""
    later = F.count("*").over(Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return plays.withColumn("_k", later).groupBy(key).agg(F.round(F.sum(F.col(reward) * F.pow(F.lit(2.0), -F.col("_k"))), 6).alias("usage"))


@query("arm_usage_ema", "select index_id, round(sum(n * pow(2.0, -k)), 6) as usage from (select *, count(*) over (partition by index_id order by round_id desc rows unbounded preceding) as k from round_config) group by index_id")
def _(spark, sf_dir):
    return halving_average(top_configs(spark, sf_dir), "index_id", "round_id", "n")


def arm_context(indexes: DataFrame, column_ids: DataFrame) -> DataFrame:
    """index_id, feature, value: 10^-place for each key column. Sparse."""
    each = indexes.select("index_id", "tab", F.posexplode("cols").alias("_pos", "col"))
    return each.join(F.broadcast(column_ids), ["tab", "col"]).select("index_id", F.col("column_id").alias("feature"), F.pow(F.lit(10.0), -F.col("_pos")).alias("value"))


@query("arm_context", "select index_id, column_id as feature, case when cols[1] = col then 1.0 else 0.1 end::double as value from indexes join workload_column using (tab) where list_contains(cols, col)")
def _(spark, sf_dir):
    return arms_of(spark, sf_dir)


def arms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.candidates import indexes_of
    from ..operators.querylog import columns_of, workload_columns

    return arm_context(indexes_of(spark, sf_dir), workload_columns(columns_of(spark, sf_dir), adapters.catalog(spark, sf_dir)))


@query("query_context", "select distinct query_id, column_id as feature from literals join workload_column using (tab, col)")
def _(spark, sf_dir):
    """The predicate columns of a query, as ids of ones."""
    from ..operators.cost import literals_of
    from ..operators.querylog import columns_of, workload_columns

    ids = workload_columns(columns_of(spark, sf_dir), adapters.catalog(spark, sf_dir))
    return literals_of(spark, sf_dir).join(F.broadcast(ids), ["tab", "col"]).select("query_id", F.col("column_id").alias("feature")).distinct()


def plays_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_id, reward: an arm's benefit, scaled."""
    from ..operators.cost import benefits_of

    return benefits_of(spark, sf_dir).select("index_id", F.round(F.col("benefit") / 1e9, 6).alias("reward"))


def ridge_statistics(contexts: DataFrame, plays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V (i, j, v) without the ridge, and b (i, v): sparse features meet themselves by play, summed before the shuffle."""
    left = contexts.join(plays, "index_id")
    right = contexts.select("index_id", F.col("feature").alias("j"), F.col("value").alias("_w"))
    v = left.join(right, "index_id").groupBy(F.col("feature").alias("i"), "j").agg(F.round(F.sum(F.col("value") * F.col("_w")), 6).alias("v"))
    b = left.groupBy(F.col("feature").alias("i")).agg(F.round(F.sum(F.col("reward") * F.col("value")), 6).alias("v"))
    return v, b


frame("arm_features", "select index_id, column_id as feature, case when cols[1] = col then 1.0 else 0.1 end::double as value from indexes join workload_column using (tab) where list_contains(cols, col)")


@query("ridge_statistics", "select a.feature as i, b.feature as j, round(sum(a.value * b.value), 6) as v from arm_features a join arm_features b using (index_id) semi join index_benefits using (index_id) group by 1, 2 union all select feature, -1, round(sum(round(benefit / 1e9, 6) * value), 6) from arm_features join index_benefits using (index_id) group by 1")
def _(spark, sf_dir):
    """V, and b as column -1."""
    v, b = ridge_statistics(arms_of(spark, sf_dir), plays_of(spark, sf_dir))
    return v.union(b.select("i", F.lit(-1), "v"))


#: Features of an arm at the most, so V fits the driver.
FEATURES = 4096


def ucb_scores(contexts: DataFrame, v: DataFrame, b: DataFrame, alpha: float = 1.0, ridge: float = 0.5) -> DataFrame:
    """index_id, ucb: theta x + alpha sqrt(x V^-1 x). V is inverted once; scores are computed by batches."""
    d = (contexts.agg(F.max("feature")).first()[0] or 0) + 1
    if d > FEATURES:
        raise ValueError(f"more than {FEATURES} features")
    matrix, target = ridge * np.eye(d), np.zeros(d)
    for r in v.collect():  # d^2 rows at the most
        matrix[r["i"], r["j"]] += r["v"]
    for r in b.collect():
        target[r["i"]] = r["v"]
    inverse = np.linalg.inv(matrix)
    shared = contexts.sparkSession.sparkContext.broadcast((inverse, inverse @ target))

    @F.arrow_udf("double")
    def score(xs: pa.Array) -> pa.Array:
        inv, theta = shared.value
        out = []
        for x in xs:
            pairs = x.as_py()
            at, value = [p["feature"] for p in pairs], np.array([p["value"] for p in pairs])
            out.append(float(theta[at] @ value + alpha * np.sqrt(max(0.0, value @ inv[np.ix_(at, at)] @ value))))
        return pa.array(out, pa.float64())

    rows = contexts.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_x"))
    return rows.select("index_id", F.round(score("_x"), 6).alias("ucb"))


@query("ucb_scores")
def _(spark, sf_dir):
    contexts = arms_of(spark, sf_dir)
    return ucb_scores(contexts, *ridge_statistics(contexts, plays_of(spark, sf_dir)))


#: A mean to 4 places, halves up, in whole millionths, so that the order of the sum plays no part.
SQL_MEAN = "((2 * sum(round(latency * 1000000)::bigint) + 100 * count(*)) // (200 * count(*)))::double / 10000"


def mean_latency() -> Column:
    return F.expr("((2 * sum(cast(round(latency * 1000000) as bigint)) + 100 * count(*)) div (200 * count(*))) / 10000.0D")


@query("config_mean_cost", f"select query as config, {SQL_MEAN} as mean_cost, count(*) as rounds from sightings group by query")
def _(spark, sf_dir):
    return templated(spark, sf_dir).groupBy(F.col("query").alias("config")).agg(mean_latency().alias("mean_cost"), F.count("*").alias("rounds"))


@query("best_config", f"select query as config, {SQL_MEAN} as mean_cost from sightings group by query order by mean_cost, query limit 1")
def _(spark, sf_dir):
    means = templated(spark, sf_dir).groupBy("query").agg(mean_latency().alias("m"))
    return means.agg(F.min_by("query", F.struct("m", "query")).alias("config"), F.min("m").alias("mean_cost"))


@query("arm_selection_count", "select index_id, count(*) as times from round_config group by index_id")
def _(spark, sf_dir):
    return top_configs(spark, sf_dir).groupBy("index_id").agg(F.count("*").alias("times"))


def early_stop_round(costs: DataFrame, k: int) -> DataFrame:
    """The first round whose last k costs are equal. costs: round_id, cost, one row a round."""
    last = Window.partitionBy(F.lit(0)).orderBy("round_id").rowsBetween(-(k - 1), 0)
    same = costs.withColumn("_n", F.count("*").over(last)).withColumn("_a", F.min("cost").over(last)).withColumn("_b", F.max("cost").over(last))
    return same.where((F.col("_n") == k) & (F.col("_a") == F.col("_b"))).agg(F.min("round_id").alias("stop_round"))


@query("early_stop_round", "select min(round_id) as stop_round from (select round_id, count(*) over w as n, min(cost) over w as a, max(cost) over w as b from (select round_id, round(avg(latency) / 20, 0) as cost from sightings group by round_id) window w as (order by round_id rows between 2 preceding and current row)) where n = 3 and a = b")
def _(spark, sf_dir):
    costs = templated(spark, sf_dir).groupBy("round_id").agg(F.round(F.avg("latency") / 20, 0).alias("cost"))
    return early_stop_round(costs, 3)


# --- streaming forms


def arrivals_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file stream of arrivals."""
    return spark.readStream.schema(schema).parquet(path)


def stream_round_windows(arrivals: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """round_windows with a watermark: rows later than it are dropped."""
    return round_windows(arrivals.withWatermark("ts", late), size, slide)


def stream_query_store(arrivals: DataFrame, memory: str, late: str) -> DataFrame:
    """query, life_start, life_end, frequency: a session a life; it ends when a query is unseen for the memory."""
    s = arrivals.withWatermark("ts", late).groupBy("query", F.session_window("ts", memory).alias("_s")).agg(F.count("*").alias("frequency"))
    return s.select("query", F.col("_s.start").alias("life_start"), F.col("_s.end").alias("life_end"), "frequency")


def stream_distinct_queries(arrivals: DataFrame, late: str) -> DataFrame:
    """The first sighting of each query within the watermark."""
    return arrivals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query"])


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, appending to files in out; run again, it goes on where it stopped. For backfills and tests."""
    q = df.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
