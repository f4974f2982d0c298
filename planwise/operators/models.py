"""Cost-model data and evaluation: labels, scaling, splits, calibration, trees, errors."""

from __future__ import annotations

from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from ..sources.twins import frame
from .cost import singles_of
from .querylog import prepared


def relative_cost_labels(costs: DataFrame) -> DataFrame:
    """query_id, index_id, label: with / without, where it is no more than 1."""
    return costs.where("without > 0").withColumn("label", F.round(F.col("with_cost") / F.col("without"), 6)).where("label <= 1").select("query_id", "index_id", "label")


@query("relative_cost_labels", "select query_id, index_id, round(with_cost / without, 6) as label from single_cost where without > 0 and round(with_cost / without, 6) <= 1")
def _(spark, sf_dir):
    return relative_cost_labels(singles_of(spark, sf_dir))


def log_bounds(df: DataFrame, value: str, shift: float) -> DataFrame:
    return df.agg(F.min(F.ln(F.col(value) + shift)).alias("_a"), F.max(F.ln(F.col(value) + shift)).alias("_b"))


def log_scale(df: DataFrame, value: str, out: str, shift: float = 0.001, low: float = 0.001, high: float = 1.0) -> DataFrame:
    """ln(x + shift), min-max over the frame, clipped. The bounds are one row."""
    scaled = (F.ln(F.col(value) + shift) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    return df.join(F.broadcast(log_bounds(df, value, shift))).withColumn(out, F.round(F.greatest(F.lit(low), F.least(F.lit(high), scaled)), 6)).drop("_a", "_b")


def log_unscale(df: DataFrame, bounds: DataFrame, scaled: str, out: str, shift: float = 0.001) -> DataFrame:
    return df.join(F.broadcast(bounds)).withColumn(out, F.round(F.exp(F.col(scaled) * (F.col("_b") - F.col("_a")) + F.col("_a")) - shift, 3)).drop("_a", "_b")


def log_sql(shift: float, low: float) -> str:
    return f"select id, round(greatest({low}, least(1.0, (ln(truth + {shift}) - min(ln(truth + {shift})) over ()) / (max(ln(truth + {shift})) over () - min(ln(truth + {shift})) over ()))), 6) as label from predictions"


@query("log_label_normalizer", log_sql(0.001, 0.001))
def _(spark, sf_dir):
    return log_scale(adapters.predictions(spark, sf_dir), "truth", "label").select("id", "label")


@query("log_label_restored", "select id, round(truth, 0) as restored from predictions where truth > (select min(truth) * 2 from predictions)")
def _(spark, sf_dir):
    rows = adapters.predictions(spark, sf_dir)
    least = rows.agg((F.min("truth") * 2).alias("_m"))
    exact = rows.join(F.broadcast(log_bounds(rows, "truth", 0.001))).withColumn("s", (F.ln(F.col("truth") + 0.001) - F.col("_a")) / (F.col("_b") - F.col("_a"))).drop("_a", "_b")
    return log_unscale(exact, log_bounds(rows, "truth", 0.001), "s", "r").join(F.broadcast(least)).where("truth > _m").select("id", F.round("r", 0).alias("restored"))


@query("log_minmax_clip", log_sql(0, 0.0))
def _(spark, sf_dir):
    return log_scale(adapters.predictions(spark, sf_dir), "truth", "label", 0.0, 0.0).select("id", "label")


def train_valid_split(df: DataFrame, key: str, valid_share: int = 20) -> DataFrame:
    """split by the key alone, so a row stays on its side whatever comes or goes."""
    return df.withColumn("split", F.when((F.col(key) * 7919) % 100 < valid_share, "valid").otherwise("train"))


frame("split_predictions", "select *, case when (id * 7919) % 100 < 20 then 'valid' else 'train' end as split from predictions")


@query("train_valid_split", "select split, count(*) as n, min(id) as first_id, max(id) as last_id from split_predictions group by split")
def _(spark, sf_dir):
    return train_valid_split(adapters.predictions(spark, sf_dir), "id").groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def calibration(train: DataFrame) -> DataFrame:
    """slope, intercept of ln(truth) over ln(pred): one mergeable aggregate."""
    return train.agg(F.regr_slope(F.ln("truth"), F.ln("pred")).alias("slope"), F.regr_intercept(F.ln("truth"), F.ln("pred")).alias("intercept"))


@query("calibrate_cost", "select id, round(exp(intercept + slope * ln(pred)), 2) as calibrated from split_predictions cross join (select regr_slope(ln(truth), ln(pred)) as slope, regr_intercept(ln(truth), ln(pred)) as intercept from split_predictions where split = 'train') where split = 'valid'")
def _(spark, sf_dir):
    rows = train_valid_split(adapters.predictions(spark, sf_dir), "id")
    model = calibration(rows.where("split = 'train'"))
    return rows.where("split = 'valid'").join(F.broadcast(model)).select("id", F.round(F.exp(F.col("intercept") + F.col("slope") * F.ln("pred")), 2).alias("calibrated"))


def q_error(eps: float = 1e-8):
    p, t = F.col("pred") + eps, F.col("truth") + eps
    return F.greatest(p / t, t / p)


@query("q_error", "select id, round(greatest((pred + 1e-8) / (truth + 1e-8), (truth + 1e-8) / (pred + 1e-8)), 6) as q from predictions")
def _(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).select("id", F.round(q_error(), 6).alias("q"))


#: Steps of the natural logarithm's unit that values are counted by before some are ordered.
STEPS = 4096


def quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row, a column a share: exact, between two neighbours in proportion. values: _q, above 0; nulls play no part.

    Values are counted by steps of their logarithm, so the steps that hold the wanted places are known; only theirs are ordered, each once.
    """
    step = values.where("_q is not null").withColumn("_b", F.floor(F.ln("_q") * STEPS))
    upto = lambda *keys: Window.partitionBy(*keys or [F.lit(0)])
    counts = step.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_to", F.sum("_n").over(upto().orderBy("_b"))).withColumn("_all", F.sum("_n").over(upto()))  # as many rows as steps
    place = lambda p: (F.col("_all") - 1) * F.lit(p)
    ends = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), f(place(p)).cast("long").alias("at"), place(p).alias("place")) for n, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    wanted = counts.select("_b", (F.col("_to") - F.col("_n")).alias("_from"), "_to", F.explode(ends).alias("_e")).where("_from <= _e.at and _e.at < _to").select("_b", "_from", "_e.*")
    here = step.join(F.broadcast(wanted.select("_b").distinct()), "_b", "left_semi").groupBy("_b", "_q").agg(F.count("*").alias("_n"))
    ordered = here.withColumn("_upto", F.sum("_n").over(upto("_b").orderBy("_q")))
    met = ordered.join(F.broadcast(wanted), "_b").where("_from + _upto - _n <= at and at < _from + _upto")

    def value(n: str) -> Column:
        low, high = (F.max(F.when((F.col("name") == n) & (F.col("side") == side), F.col("_q"))) for side in ("low", "high"))
        part = F.max(F.when(F.col("name") == n, F.col("place") - F.floor("place")))
        return ((1 - part) * low + part * high).alias(n)

    return met.agg(*[value(n) for n in shares])


def q_error_summary(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """mean, median, p90, p95, p99, max. approximate: by mergeable sketches, in one pass."""
    shares = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    values = rows.select(q_error().alias("_q"))
    ends = [F.avg("_q").alias("mean"), F.max("_q").alias("largest")]
    if approximate:
        summary = values.agg(*ends, *[F.percentile_approx("_q", p, 10_000).alias(n) for n, p in shares.items()])
    else:
        values = values.persist()  # read twice
        summary = values.agg(*ends).join(F.broadcast(quantiles(values, shares)))
    return summary.select(*[F.round(c, 4).alias(c) for c in ("mean", *shares, "largest")])


@query("q_error_summary", "select round(avg(q), 4) as mean, round(quantile_cont(q, 0.5), 4) as median, round(quantile_cont(q, 0.9), 4) as p90, round(quantile_cont(q, 0.95), 4) as p95, round(quantile_cont(q, 0.99), 4) as p99, round(max(q), 4) as largest from (select greatest((pred + 1e-8) / (truth + 1e-8), (truth + 1e-8) / (pred + 1e-8)) as q from predictions)")
def _(spark, sf_dir):
    return q_error_summary(adapters.predictions(spark, sf_dir))


def classification_f1(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, f1 of (pred > t) against (truth > t); rows whose truth is 0 are left out."""
    ts = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    p, t = F.col("pred") > F.col("threshold"), F.col("truth") > F.col("threshold")
    counts = rows.where("truth != 0").select("pred", "truth", ts).groupBy("threshold").agg(F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p & ~t, 1)).alias("fp"), F.count(F.when(~p & t, 1)).alias("fn"))
    return counts.withColumn("f1", F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6))


@query("classification_f1", "select threshold, tp, fp, fn, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) as f1 from (select threshold, count(*) filter (p > threshold and t > threshold) as tp, count(*) filter (p > threshold and t <= threshold) as fp, count(*) filter (p <= threshold and t > threshold) as fn from (select pred / 400000 as p, truth / 400000 as t from predictions) cross join (values (0.05::double), (0.2::double), (0.5::double)) c(threshold) where t != 0 group by threshold)")
def _(spark, sf_dir):
    rows = adapters.predictions(spark, sf_dir).select((F.col("pred") / 400000).alias("pred"), (F.col("truth") / 400000).alias("truth"))
    return classification_f1(rows, [0.05, 0.2, 0.5])


@query("mape", "select round(avg(abs(pred - truth) / truth), 6) as mape from predictions")
def _(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).agg(F.round(F.avg(F.abs(F.col("pred") - F.col("truth")) / F.col("truth")), 6).alias("mape"))


@query("rmse", "select round(sqrt(avg((pred - truth) * (pred - truth))), 2) as rmse from predictions")
def _(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).agg(F.round(F.sqrt(F.avg((F.col("pred") - F.col("truth")) * (F.col("pred") - F.col("truth")))), 2).alias("rmse"))


@query("log_correlation", "select round(corr(ln(pred), ln(truth)), 6) as r from predictions")
def _(spark, sf_dir):
    return adapters.predictions(spark, sf_dir).agg(F.round(F.corr(F.ln("pred"), F.ln("truth")), 6).alias("r"))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features, label, split: an order's lines as features of its price."""
    lines = adapters.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    rows = train_valid_split(adapters.predictions(spark, sf_dir).join(lines, "id"), "id")
    return VectorAssembler(inputCols=["lines", "quantity", "price", "discount"], outputCol="raw").transform(rows).withColumn("label", F.ln("truth"))


def feature_minmax(rows: DataFrame) -> DataFrame:
    """features scaled by the training rows' extremes."""
    return MinMaxScaler(inputCol="raw", outputCol="features").fit(rows.where("split = 'train'")).transform(rows)


@query("feature_minmax", "select id, round((lines - a) / (b - a), 6) as first_feature from (select id, split, count(*)::double as lines from lineitem join split_predictions on l_orderkey = id group by id, split) cross join (select min(n) as a, max(n) as b from (select count(*)::double as n from lineitem join split_predictions on l_orderkey = id where split = 'train' group by id))")
def _(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    return feature_minmax(part_features(spark, sf_dir)).select("id", F.round(vector_to_array("features")[0], 6).alias("first_feature"))


def fit_trees(rows: DataFrame, kind: str = "boosted", features: str = "features", label: str = "label", seed: int = 666):
    model = GBTRegressor(featuresCol=features, labelCol=label, maxIter=10, maxDepth=4, seed=seed) if kind == "boosted" else RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=10, maxDepth=5, seed=seed)
    return model.fit(rows)


@query("fit_tree_cost")
def _(spark, sf_dir):
    """Predicted prices of the validation rows by boosted trees on the log label."""
    rows = feature_minmax(part_features(spark, sf_dir)).select("id", "features", "label", "truth", "split")
    model = fit_trees(rows.where("split = 'train'"))
    return model.transform(rows.where("split = 'valid'")).select("id", "truth", F.exp("prediction").alias("pred"))


def fit_index_filter(vectors: DataFrame, labels: DataFrame, kind: str = "boosted", seed: int = 666):
    """A model of an index's relative gain from a plan's 55 numbers, fitted on the training queries, and its rows.

    vectors: plan_id, index_id, features. labels: query_id, index_id, label. Rows: query_id, index_id, features, label (null where none is known), split.
    """
    from pyspark.ml.functions import array_to_vector

    known = vectors.withColumnRenamed("plan_id", "query_id").join(labels, ["query_id", "index_id"], "left")
    rows = train_valid_split(known.withColumn("features", array_to_vector("features")), "query_id")
    return fit_trees(rows.where("split = 'train' and label is not null"), kind, seed=seed), rows


#: The least relative gain that a candidate is kept for.
LEAST_GAIN = 0.05


@query("fit_index_filter")
def _(spark, sf_dir):
    """Each plan's candidates with the predicted gain and whether it is worth keeping; the trees are beyond SQL."""
    from ..plans.planlog import filter_training_rows, filter_vectors_of

    model, rows = fit_index_filter(filter_vectors_of(spark, sf_dir), filter_training_rows(singles_of(spark, sf_dir)))
    scored = model.transform(rows)
    return scored.select("query_id", "index_id", "split", "label", F.col("prediction").alias("gain"), (F.col("prediction") > LEAST_GAIN).alias("kept"))


@query("predict_workload_cost", "select round(sum(exp(ln(without)) * freq), 0) as predicted from (select query_id, sum(scan) as without from scan_cost group by query_id) join workload using (query_id)")
def _(spark, sf_dir):
    """The sum of exp(prediction) * freq; here the prediction is each query's own log cost."""
    from .cost import scans_of

    logs = scans_of(spark, sf_dir).groupBy("query_id").agg(F.ln(F.sum("scan")).alias("prediction"))
    return logs.join(prepared(spark, sf_dir).select("query_id", "freq"), "query_id").agg(F.round(F.sum(F.exp("prediction") * F.col("freq")), 0).alias("predicted"))
