"""Choosing a configuration in rounds: each round costs every candidate against every query in one job, and its best, or relaxation's sums by indexes, reach the driver.

State is the cost of each (query, table) under what is chosen so far; a round joins the candidates'
access costs to it, so its work is the size of the access table. Rounds are as many as indexes are
chosen or dropped. The state is written between rounds where a shared folder is named, so lineage
stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

import itertools
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from .candidates import WIDTH, candidates_of, index_id, index_sizes, permutations, sized_of
from .cost import access_costs, accesses_of, column_selectivity, combine_subsumed, literals_of, ratio_order, ratios_of, scans_of
from .profile import all_stats
from .querylog import columns_of, prepared

TRACE = "step int, index_id string, score double, cost double"
#: Relaxations, the plainest first.
CHANGES = ["removal", "prefixing", "merging", "splitting"]


def cut(df: DataFrame) -> DataFrame:
    """Written in the folder of spark.checkpoint.dir and read again; in a session without one, kept as it is."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/select-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def weighted(scans: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, tab, now, freq: the state before anything is chosen."""
    return scans.join(weights.select("query_id", "freq"), "query_id").select("query_id", "tab", F.col("scan").alias("now"), "freq")


def total(state: DataFrame) -> float:
    return state.agg(F.sum(F.col("now") * F.col("freq"))).first()[0] or 0.0


def gains(state: DataFrame, accesses: DataFrame) -> DataFrame:
    """index_id, gain: what adding each index alone would save now."""
    better = accesses.join(state, ["query_id", "tab"]).where("icost < now")
    return better.groupBy("index_id").agg(F.sum((F.col("now") - F.col("icost")) * F.col("freq")).alias("gain"))


def best_alone(state: DataFrame, accesses: DataFrame, most: int | None) -> DataFrame:
    """index_id, gain of the candidates with a gain: all of them, or the most best."""
    rated = gains(state, accesses)
    return rated if most is None else rated.orderBy(F.desc(F.round("gain", 4)), "index_id").limit(most)


def with_index(state: DataFrame, accesses: DataFrame, chosen: str) -> DataFrame:
    own = accesses.where(F.col("index_id") == chosen).select("query_id", "tab", "icost")
    return state.join(own, ["query_id", "tab"], "left").select("query_id", "tab", F.least("now", F.coalesce("icost", "now")).alias("now"), "freq")


def select_extend(sized: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame, budget_bytes: int, improvement: float = 1.003, most: int | None = None) -> DataFrame:
    """step, index_id, score (gain per megabyte), cost: each step adds a single-column index or extends a chosen one.

    An extension takes the place of its parent, whose size it keeps paying for once. A step must bring
    the cost below current / improvement; it ends where none fits and does, or after most steps. With a budget of 0 nothing is chosen.
    """
    spark = sized.sparkSession
    sizes = sized.select("index_id", "tab", "width", "size_bytes", index_id(cols=F.slice("cols", F.lit(1), F.greatest(F.size("cols") - 1, F.lit(1)))).alias("parent"))
    state, chosen, used, trace = cut(weighted(scans, weights)), {}, 0, []
    current = total(state)
    while most is None or len(trace) < most:
        own = spark.createDataFrame([(i, s) for i, s in chosen.items()], "own string, own_bytes long")
        open_ = sizes.join(F.broadcast(own), F.col("parent") == F.col("own"), "left").where("width = 1 or own is not null").withColumn("extra", F.col("size_bytes") - F.when(F.col("width") > 1, F.col("own_bytes")).otherwise(0))
        fits = open_.where((F.col("extra") + used <= budget_bytes) & ~F.col("index_id").isin(*chosen or [""]))
        scored = gains(state, accesses).join(fits, "index_id").withColumn("score", F.col("gain") / (F.col("extra") / 1e6)).where(F.lit(current) - F.col("gain") < current / improvement)
        best = scored.orderBy(F.desc("score"), "width", "index_id").select("index_id", "width", "parent", "extra", "size_bytes", "gain", "score").limit(1).collect()
        if not best:
            break
        b = best[0]
        if b["width"] > 1:
            chosen.pop(b["parent"])
        chosen[b["index_id"]] = b["size_bytes"]
        used += b["extra"]
        state = cut(with_index(state, accesses, b["index_id"]))
        current -= b["gain"]
        trace.append((len(trace) + 1, b["index_id"], round(b["score"], 4), round(current, 2)))
    return spark.createDataFrame(trace, TRACE)


def select_auto_admin(sized: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame, count: int) -> DataFrame:
    """step, index_id, score (gain), cost: candidates are each query's best index by table, found in one job; then greedy enumeration by workload cost."""
    spark = sized.sparkSession
    best = accesses.join(scans, ["query_id", "tab"]).where("icost < scan").groupBy("query_id", "tab").agg(F.min_by("index_id", F.struct("icost", F.length("index_id"), "index_id")).alias("index_id"))
    usable = cut(accesses.join(best.select("index_id").distinct(), "index_id", "left_semi"))
    state, trace, taken = cut(weighted(scans, weights)), [], [""]
    current = total(state)
    while len(trace) < count:
        top = gains(state, usable).where(~F.col("index_id").isin(*taken)).orderBy(F.desc(F.round("gain", 4)), "index_id").limit(1).collect()
        if not top:
            break
        taken.append(top[0]["index_id"])
        current -= top[0]["gain"]
        trace.append((len(trace) + 1, top[0]["index_id"], round(top[0]["gain"], 4), round(current, 2)))
        state = cut(with_index(state, usable, top[0]["index_id"]))
    return spark.createDataFrame(trace, TRACE)


def two_best(chosen: DataFrame, accesses: DataFrame) -> DataFrame:
    """query_id, tab, first, first_cost, second_cost among the chosen indexes: what a table falls back to if its best goes."""
    ranked = accesses.join(F.broadcast(chosen), "index_id").groupBy("query_id", "tab").agg(F.min(F.struct("icost", "index_id")).alias("_a"), F.array_sort(F.collect_list("icost")).alias("_c"))
    return ranked.select("query_id", "tab", F.col("_a.index_id").alias("first"), F.col("_a.icost").alias("first_cost"), F.try_element_at("_c", F.lit(2)).alias("second_cost"))


def losses(chosen: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame) -> DataFrame:
    """index_id, loss: what removing each chosen index alone would cost; one job for all."""
    met = two_best(chosen, accesses).join(scans, ["query_id", "tab"]).join(weights.select("query_id", "freq"), "query_id").where("first_cost < scan")
    lost = met.groupBy(F.col("first").alias("index_id")).agg(F.sum((F.least("scan", F.coalesce("second_cost", "scan")) - F.col("first_cost")) * F.col("freq")).alias("loss"))
    return chosen.join(lost, "index_id", "left").select("index_id", F.coalesce("loss", F.lit(0.0)).alias("loss"))


def select_drop(sized: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame, count: int, start: int | None = None) -> DataFrame:
    """step, index_id, score (loss), cost of the dropped ones; it starts from all with a benefit, or the start best, and drops the least loss until count remain.

    An index without a benefit alone has none beside others either, so leaving it out changes no later step.
    """
    spark = sized.sparkSession
    chosen = cut(best_alone(cut(weighted(scans, weights)), accesses, start).select("index_id"))
    trace, accesses, left = [], cut(accesses.join(chosen, "index_id", "left_semi")), chosen.count()
    while left > count:
        worst = losses(chosen, scans, accesses, weights).orderBy(F.round("loss", 4), F.desc("index_id")).limit(1).collect()[0]
        chosen, left = cut(chosen.where(F.col("index_id") != worst["index_id"])), left - 1
        trace.append((len(trace) + 1, worst["index_id"], round(worst["loss"], 4), 0.0))
    return spark.createDataFrame(trace, TRACE)


def usable(indexes: DataFrame, base: DataFrame, selectivity: DataFrame, rows: DataFrame) -> DataFrame:
    """tab, scan, freq, uses: for queries that an index serves, every index that costs less than their scan, as (cost, id), the least cost first.

    An index serves a query that has a predicate on its leading column, whether or not the query has its other columns.
    Costs are whole ten-thousandths, so sums are exact in any order; queries alike are one row.
    """
    whole = lambda c: F.round(F.col(c) * 10_000).cast("long")
    led = indexes.withColumn("col", F.col("cols")[0]).join(selectivity.select("query_id", "tab", "col"), ["tab", "col"])
    met = base.join(access_costs(led, selectivity, rows), ["query_id", "tab"]).where("icost < now")
    each = met.groupBy("query_id", "tab").agg(F.max(whole("now")).alias("scan"), F.max("freq").alias("freq"), F.array_sort(F.collect_list(F.struct(whole("icost").alias("cost"), "index_id"))).alias("uses"))
    return each.groupBy("tab", "scan", "uses").agg(F.sum("freq").alias("freq"))


def relaxations(chosen: set[tuple], width: int) -> dict[tuple, str]:
    """(gone, made) to the change that does it: removal, cut to a prefix, merging two indexes of a table, or splitting two that share columns.

    An index is (tab, cols). What stays or is there already is in neither set; of changes with the same outcome the plainest is named.
    """
    found: dict[tuple, str] = {}

    def add(change: str, gone: set, made: set) -> None:
        if gone - made:
            found.setdefault((frozenset(gone - made), frozenset(made - chosen)), change)

    for i in chosen:
        add("removal", {i}, set())
    for tab, cols in chosen:
        for n in range(1, len(cols)):
            add("prefixing", {(tab, cols)}, {(tab, cols[:n])})
    pairs = [(tab, a, b) for (tab, a), (other, b) in itertools.permutations(sorted(chosen), 2) if tab == other]
    for tab, a, b in pairs:
        add("merging", {(tab, a), (tab, b)}, {(tab, (a + tuple(c for c in b if c not in a))[:width])})
    for tab, a, b in pairs:
        common, rest_a, rest_b = (tuple(c for c in x if (c in y) == both) for x, y, both in ((a, b, True), (a, b, False), (b, a, False)))
        if common:
            add("splitting", {(tab, a), (tab, b)}, {(tab, cols) for cols in (common, rest_a, rest_b) if cols})
    return found


def rises(uses: DataFrame, held: dict[str, list[str]], made: dict[str, list[list[str]]]) -> dict[tuple, dict[tuple, tuple]]:
    """(tab, number of a set in made) to {(first, second): sums}: how the cost changes if the set's indexes are added to the held ones.

    first and second are a query's two best held indexes, where it has them. The sums: the change as long as first stays, what more
    it costs if first goes, and what more if both go. One job for all sets; at most two indexes go at a time, so the third best tells the rest.
    """
    own = uses.sparkSession.createDataFrame([(t, ids, made[t]) for t, ids in held.items()], "tab string, held array<string>, made array<array<string>>")
    met = uses.join(F.broadcast(own), "tab").withColumn("_best", F.filter("uses", lambda u: F.array_contains("held", u["index_id"])))
    first, second, third = (F.get("_best", F.lit(k)) for k in range(3))
    each = met.select("tab", "uses", "freq", first["index_id"].alias("first"), second["index_id"].alias("second"), *[F.coalesce(x["cost"], F.col("scan")).alias(f"_c{k}") for k, x in enumerate((first, second, third))], F.posexplode("made").alias("made", "_set"))
    added = each.withColumn("_a", F.array_min(F.transform(F.filter("uses", lambda u: F.array_contains("_set", u["index_id"])), lambda u: u["cost"])))
    costs = [F.col("_c0"), *[F.least(f"_c{k}", "_a") for k in range(3)]]
    sums = [F.sum((b - a).cast("decimal(18,0)") * F.col("freq").cast("decimal(18,0)")).alias(f"_s{k}") for k, (a, b) in enumerate(zip(costs, costs[1:]))]
    found: dict[tuple, dict[tuple, tuple]] = {}
    for r in added.groupBy("tab", "made", "first", "second").agg(*sums).collect():  # pairs of held indexes that meet in a query
        found.setdefault((r["tab"], r["made"]), {})[r["first"], r["second"]] = tuple(int(r[f"_s{k}"]) for k in range(3))
    return found


RELAXED = TRACE + ", change string, made string"


def select_relaxation(sized: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame, stats: DataFrame, selectivity: DataFrame, budget_bytes: int, start: int | None = None, width: int = WIDTH) -> DataFrame:
    """step, index_id, score (penalty), cost, change, made: from all indexes with a benefit, or the start best, by relaxations until the budget holds.

    A row an index that goes; made are those that come, joined by `;`. Each step takes the relaxation that saves bytes with the least
    penalty: the cost rise over the bytes saved, no more of them than still needed, or a fall of the cost times the bytes saved; of equal ones that which makes the
    fewest indexes, then that which saves the most bytes.
    stats and selectivity as column_stats and column_selectivity give them: indexes that no query proposed have sizes and costs too.
    """
    spark = sized.sparkSession
    base = cut(weighted(scans, weights))
    begin = best_alone(base, accesses, start).join(sized, "index_id").select("index_id", "tab", "cols")
    chosen = {(r["tab"], tuple(r["cols"])) for r in begin.collect()}
    columns = spark.createDataFrame(sorted({(tab, c) for tab, cols in chosen for c in cols}), "tab string, col string")
    every = cut(index_sizes(permutations(columns, [], width), stats))  # prefixes, merged and split indexes have columns of the first ones only
    known = {(r["tab"], tuple(r["cols"])): (r["index_id"], r["size_bytes"]) for r in every.collect()}
    ids, sizes = {i: k for i, (k, _) in known.items()}, {i: n for i, (_, n) in known.items()}
    uses = cut(usable(every, base, selectivity, stats.groupBy("tab").agg(F.max("rows").alias("rows"))))
    by_tab = lambda: {t: [ids[i] for i in sorted(chosen) if i[0] == t] for t, _ in chosen}
    first = rises(uses, {t: [] for t in by_tab()}, {t: [of] for t, of in by_tab().items()})  # from none to all of the first ones
    step, trace, current = 0, [], round(total(base) * 10_000) + sum(s[0] for of in first.values() for s in of.values())
    while (over := sum(sizes[i] for i in chosen) - budget_bytes) > 0:
        options = {o: c for o, c in relaxations(chosen, width).items() if o[1] <= sizes.keys() and sum(map(sizes.get, o[0])) > sum(map(sizes.get, o[1]))}
        sets = {t: sorted({tuple(sorted(ids[i] for i in made)) for gone, made in options if next(iter(gone))[0] == t}) for t in by_tab()}
        places = {(t, s): k for t, of in sets.items() for k, s in enumerate(of)}
        sums = rises(uses, by_tab(), sets)
        rated = []
        for (gone, made), change in options.items():
            tab, old, new = next(iter(gone))[0], {ids[i] for i in gone}, tuple(sorted(ids[i] for i in made))
            by = sums.get((tab, places[tab, new]), {})
            rise = sum(s[0] + (s[1] + (s[2] if second in old else 0) if first in old else 0) for (first, second), s in by.items())
            saved = sum(map(sizes.get, gone)) - sum(map(sizes.get, made))
            rated.append((Fraction(rise, min(saved, over)) if rise >= 0 else Fraction(rise * saved), len(made), -saved, CHANGES.index(change), sorted(old), new, rise, gone, made))
        penalty, _, _, change, old, new, rise, gone, made = min(rated, key=lambda r: r[:6])
        chosen = chosen - gone | made
        step, current = step + 1, current + rise
        trace += [(step, i, round(float(penalty / 10_000), 6), round(current / 10_000, 2), CHANGES[change], ";".join(new)) for i in old]
    return spark.createDataFrame(trace, RELAXED)


def select_anytime(sized: DataFrame, scans: DataFrame, accesses: DataFrame, weights: DataFrame, budget_bytes: int, seeds: int | None = None, steps: int | None = None) -> DataFrame:
    """seed, indexes, cost: greedy from each single index with a benefit that fits, or the seeds best of them, and from none; all seeds take a step in one job.

    It ends when no seed has an index left that gains and fits, or after the given steps.
    """
    spark = sized.sparkSession
    base = cut(weighted(scans, weights))
    fitting = accesses.join(sized.where(F.col("size_bytes") <= budget_bytes).select("index_id"), "index_id", "left_semi")
    size = {r["index_id"]: r["size_bytes"] for r in best_alone(base, fitting, seeds).join(sized.select("index_id", "size_bytes"), "index_id").orderBy(F.desc(F.round("gain", 4)), "index_id").collect()}
    sets = {s: [s] if s else [] for s in ["", *size]}
    used = {s: size.get(s, 0) for s in sets}
    costs = {}
    for step in itertools.count():
        rows = spark.createDataFrame([(s, i) for s, ids in sets.items() for i in ids], "seed string, index_id string")
        best = accesses.join(F.broadcast(rows), "index_id").groupBy("seed", "query_id", "tab").agg(F.min("icost").alias("_i"))
        room = spark.createDataFrame([(s, budget_bytes - u) for s, u in used.items()], "seed string, room long")
        state = base.join(F.broadcast(room)).join(best, ["seed", "query_id", "tab"], "left").select("seed", "room", "query_id", "tab", F.least("now", F.coalesce("_i", "now")).alias("now"), "freq")
        costs = {r["seed"]: r["c"] for r in state.groupBy("seed").agg(F.sum(F.col("now") * F.col("freq")).alias("c")).collect()}
        if step == steps:
            break
        offers = state.join(accesses, ["query_id", "tab"]).where("icost < now").groupBy("seed", "room", "index_id").agg(F.sum((F.col("now") - F.col("icost")) * F.col("freq")).alias("gain"))
        fits = offers.join(sized.select("index_id", "size_bytes"), "index_id").where("size_bytes <= room")
        top = fits.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(F.round("gain", 4)), "index_id"))).where("_r = 1").collect()
        if not top:
            break
        for r in top:
            sets[r["seed"]].append(r["index_id"])
            used[r["seed"]] += r["size_bytes"]
    return spark.createDataFrame([(s, ";".join(ids), round(costs.get(s, 0.0), 2)) for s, ids in sets.items()], "seed string, indexes string, cost double")


def select_swaps(rated: DataFrame, accesses: DataFrame, scans: DataFrame, weights: DataFrame, count: int, variations: int = 16) -> DataFrame:
    """variation, cost: sets that swap one of the greedy count for a runner-up, by a keyed choice; all are costed in one job. Variation 0 swaps nothing."""
    spark = rated.sparkSession
    ids = [r["index_id"] for r in rated.orderBy(*ratio_order()).limit(2 * count).collect()]
    own, rest = ids[:count], ids[count:] or ids[:count]
    sets = [(v, i) for v in range(variations) for i in (own if v == 0 else [x for k, x in enumerate(own) if k != v * 7 % max(1, len(own))] + [rest[v * 13 % len(rest)]])] if own else []
    rows = spark.createDataFrame(sets, "variation int, index_id string").distinct()
    best = accesses.join(F.broadcast(rows), "index_id").groupBy("variation", "query_id", "tab").agg(F.min("icost").alias("_i"))
    state = weighted(scans, weights).join(F.broadcast(rows.select("variation").distinct())).join(best, ["variation", "query_id", "tab"], "left")
    return state.groupBy("variation").agg(F.round(F.sum(F.least("now", F.coalesce("_i", "now")) * F.col("freq")), 2).alias("cost"))


def uses_of_arms(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """query_id, tab, index_id, whole: the queries of each arm, and whether it has all columns that the query touches in the table."""
    touched = columns.groupBy("query_id", "tab").agg(F.countDistinct("col").alias("_n"))
    return candidates.join(touched, ["query_id", "tab"]).select("query_id", "tab", "index_id", (F.col("width") == F.col("_n")).alias("whole"))


def arms_without_conflicts(scored: DataFrame, uses: DataFrame, budget_bytes: int, per_table: int = 6) -> DataFrame:
    """place, index_id, score: the arms with a score above 0, best first, but those that do not fit or that one chosen before rules out.

    An arm rules out those with its first column (so its prefixes too), those of its table beyond the quota, those that are whole for a
    query that it is whole for, and those whose every query has an arm that is whole for it. uses: as uses_of_arms gives them.
    Each round filters and orders all arms in Spark, and its best reaches the driver: as many rounds as arms are chosen.
    """
    spark = scored.sparkSession
    arms = cut(scored.where("score > 0").select("index_id", "tab", "size_bytes", "score", F.substring_index("index_id", ",", 1).alias("lead")))
    uses, key = cut(uses), ["query_id", "tab"]
    room, chosen, leads, tables = budget_bytes, [], [""], {}
    while True:
        own = spark.createDataFrame([(c[1],) for c in chosen], "index_id string")
        met = uses.where("whole").join(F.broadcast(own), "index_id", "left_semi").select(*key).distinct()
        open_ = uses.join(met, key, "left_anti").select("index_id").distinct()
        alike = uses.where("whole").join(met, key, "left_semi").select("index_id").distinct()
        full = ["", *(t for t, n in tables.items() if n >= per_table)]
        free = arms.where((F.col("size_bytes") <= room) & ~F.col("lead").isin(leads) & ~F.col("tab").isin(full))
        best = free.join(open_, "index_id", "left_semi").join(alike, "index_id", "left_anti").orderBy(F.desc("score"), "index_id").limit(1).collect()
        if not best:
            break
        b = best[0]
        room -= b["size_bytes"]
        tables[b["tab"]] = tables.get(b["tab"], 0) + 1
        leads.append(b["lead"])
        chosen.append((len(chosen) + 1, b["index_id"], b["score"]))
    return spark.createDataFrame(chosen, "place int, index_id string, score double")


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sizes, scans, accesses, weights; each made once a query."""
    return tuple(cut(f(spark, sf_dir)) for f in (sized_of, scans_of, accesses_of, prepared))


def budget(spark: SparkSession, sf_dir: str, share: float = 0.2) -> int:
    """A share of all tables' bytes, so it grows with them."""
    return int(all_stats(spark, sf_dir).agg(F.sum(F.col("rows") * F.col("width"))).first()[0] * share)


@query("select_extend")
def _(spark, sf_dir):
    return select_extend(*inputs(spark, sf_dir), budget(spark, sf_dir))


@query("select_auto_admin")
def _(spark, sf_dir):
    return select_auto_admin(*inputs(spark, sf_dir), 4)


@query("select_drop")
def _(spark, sf_dir):
    return select_drop(*inputs(spark, sf_dir), 8)


@query("select_relaxation")
def _(spark, sf_dir):
    stats = all_stats(spark, sf_dir)
    return select_relaxation(*inputs(spark, sf_dir), stats, column_selectivity(literals_of(spark, sf_dir), stats), budget(spark, sf_dir))


@query("select_anytime")
def _(spark, sf_dir):
    return select_anytime(*inputs(spark, sf_dir), budget(spark, sf_dir))


@query("select_swap_variations")
def _(spark, sf_dir):
    sized, scans, accesses, weights = inputs(spark, sf_dir)
    return select_swaps(ratios_of(spark, sf_dir), accesses, scans, weights, 5)


@query("select_ucb_arms")
def _(spark, sf_dir):
    from ..streaming.rounds import arms_of, plays_of, ridge_statistics, ucb_scores

    contexts = arms_of(spark, sf_dir)
    scores = ucb_scores(contexts, *ridge_statistics(contexts, plays_of(spark, sf_dir))).select("index_id", F.col("ucb").alias("score"))
    uses = uses_of_arms(candidates_of(spark, sf_dir), columns_of(spark, sf_dir))
    return arms_without_conflicts(sized_of(spark, sf_dir).join(scores, "index_id"), uses, budget(spark, sf_dir))


@query("select_all", "select index_id, size_bytes from index_sizes")
def _(spark, sf_dir):
    return sized_of(spark, sf_dir).select("index_id", "size_bytes")


@query("select_none", "select index_id, size_bytes from index_sizes where false")
def _(spark, sf_dir):
    return sized_of(spark, sf_dir).select("index_id", "size_bytes").where("false")


@query("selection_trace", "select 1 as step, index_id, ratio as score, row_number() over (order by ratio desc, width, index_id) = 1 as chosen from combined")
def _(spark, sf_dir):
    """Every candidate's score in the first round, and whether it was chosen."""
    rated = combine_subsumed(ratios_of(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ratio_order()))
    return rated.select(F.lit(1).alias("step"), "index_id", F.col("ratio").alias("score"), (place == 1).alias("chosen"))
