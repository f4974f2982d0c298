"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Each source's documents, in an order that a hash of the id shuffles, are cut into blocks. A source
of weight a/PERIOD releases its block k (from 1) at slot floor((k-1) PERIOD / a) and must have it
placed before slot ceil(k PERIOD / a). Earliest deadline first places one block a slot; with weights
that add up to one, every block lands in its window, so after any number of slots a source differs
from its share by less than one block. The schedule repeats after PERIOD slots, so one period is
computed, by a fold over its slots, and every block's slot follows from it by arithmetic.

No document is left out or repeated: a source that runs dry leaves its later slots empty, and the
others keep their shares of what remains. Ranks within a source come from counts by hash range, so
no task sorts a whole source.

More than PERIOD / 2 sources lengthen the period, to twice as many slots as sources at least; the fold takes
sources times slots steps on one row: seconds for a hundred sources, many minutes for a thousand.

A null source is a source of its own. Null ids and repeated rows keep their places, ties in any
order among equal rows. Weights of sources that are not in the data are ignored; a source without a
weight counts as weight 0 and is placed in one slot after the others'. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import never_null, running_total

#: Slots of a period (weights are multiples of 1/PERIOD) and documents of a block.
PERIOD, BLOCK = 1000, 64


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """source, weight: the square root of a source's documents in thousandths, which lifts small sources and lowers large ones."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.floor(F.sqrt(F.count("*").cast("double")) * 1000).cast("long").alias("weight"))


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """source, a: whole shares of the period that add up to it, at least 1 each, by largest remainders. weights: source, weight."""
    known = weights.where("weight > 0")
    total = known.agg(F.sum("weight").alias("_total"), F.count("*").alias("_n"))
    whole = known.join(F.broadcast(total)).withColumn("_give", F.lit(period) - F.col("_n"))  # total is one row
    whole = whole.withColumn("_floor", F.floor(F.col("weight") * F.col("_give") / F.col("_total")).cast("long"))
    whole = whole.withColumn("_rest", F.col("weight") * F.col("_give") - F.col("_floor") * F.col("_total"))
    every = Window.partitionBy(F.lit(0))  # a row a source
    left = F.lit(period) - F.col("_n") - F.sum("_floor").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("_rest"), "source"))
    return whole.withColumn("_left", left).withColumn("_rank", rank).select("source", (1 + F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("a"))


def template(share: DataFrame, period: int = PERIOD) -> DataFrame:
    """slot, source, a, k: the k-th block of a period of each source, and where earliest-deadline-first puts it."""
    def release(k: Column, a: Column) -> Column:
        return F.floor((k - 1) * period / a)

    def deadline(k: Column, a: Column) -> Column:
        return F.ceil(k * period / a)

    one = share.agg(F.array_sort(F.collect_list(F.struct("source", "a"))).alias("sources"))
    one = one.withColumn("a", F.transform("sources", lambda s: s["a"]))
    start = F.struct(F.transform("a", lambda a: F.lit(1).cast("long")).alias("next"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        # (deadline, release, place) of each source's next block if it is released by this slot
        ready = F.transform(F.arrays_zip(F.col("a"), state["next"]), lambda s, i: F.when(release(s["next"], s["a"]) <= slot, F.struct(deadline(s["next"], s["a"]).alias("d"), release(s["next"], s["a"]).alias("r"), i.alias("i"))))
        chosen = F.array_min(F.filter(ready, lambda x: x.isNotNull()))["i"]
        return F.struct(F.transform(state["next"], lambda k, i: F.when(i == chosen, k + 1).otherwise(k)).alias("next"), F.concat(state["order"], F.array(chosen)).alias("order"))

    folded = one.select("sources", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda s: s["order"]).alias("order"))
    slots = folded.select("sources", F.posexplode("order").alias("slot", "_i")).where("_i is not null")
    slots = slots.select("slot", F.element_at("sources", F.col("_i") + 1).alias("_s")).select("slot", "_s.source", "_s.a")
    return slots.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long"))


def ranked(docs: DataFrame, doc_id: str, source: str) -> DataFrame:
    """source, doc_id, first, n: each pair once, with its place within the source, from 0, in the order of the id's MD5, and its rows.

    Pairs are narrow, so only ids are ordered; counts by the MD5's first 12 bits come first, so windows stay small.
    """
    pairs = docs.groupBy(F.col(source).alias("source"), F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    return running_total(pairs, ["source"], F.substring("md5", 1, 3), ["md5", "doc_id"], {"first": "n"}).drop("md5")


def period_for(sources: int, period: int = PERIOD) -> int:
    """The period, or the least multiple of it that gives every source two slots."""
    return period * max(1, -(-2 * sources // period))


#: Names of columns between steps, which no input has.
BETWEEN = {c: f"__mix_{c}" for c in ("source", "id", "first", "n", "place", "digest", "a", "k", "slot", "of")}


def schedule(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", period: int = PERIOD, block: int = BLOCK) -> DataFrame:
    """docs with the columns mix_block (from 1, within its source), mix_slot and mix_offset (place in its block), which take the place of any of these names.

    Rows in the order (mix_slot, mix_offset) are the mix. Whole rows meet their places in one join; of rows
    with one source and id, those of equal ids are placed by a hash of all their columns.
    """
    named, b = docs.columns, BETWEEN
    given = root_weights(docs, source) if weights is None else weights
    period = period_for(given.where("weight > 0").count(), period)
    plan = template(shares(given, period), period).select(F.col("slot").alias(b["slot"]), F.col("source").alias(b["source"]), F.col("a").alias(b["a"]), F.col("k").alias(b["k"]))
    places = ranked(docs, doc_id, source).select(never_null(F.col("source")).alias(b["source"]), never_null(F.col("doc_id")).alias(b["id"]), F.col("first").alias(b["first"]), F.col("n").alias(b["n"]))
    rows = docs.withColumns({b["source"]: never_null(F.col(source)), b["id"]: never_null(F.col(doc_id))}).join(places, [b["source"], b["id"]])
    single = rows.where(F.col(b["n"]) == 1).withColumn(b["place"], F.lit(0).cast("long"))
    many = rows.where(F.col(b["n"]) > 1).withColumn(b["digest"], F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in named])))).withColumn(b["of"], F.lit(1).cast("long"))
    many = running_total(many, [b["source"], b["id"]], F.shiftright(b["digest"], 52), [b["digest"]], {b["place"]: b["of"]}).drop(b["digest"], b["of"])
    placed = single.unionByName(many).withColumn(b["place"], F.col(b["place"]) + F.col(b["first"]))
    placed = placed.withColumn("mix_block", F.floor(F.col(b["place"]) / block) + 1).withColumn("mix_offset", (F.col(b["place"]) % block).cast("int"))
    placed = placed.drop(b["source"], b["id"], b["first"], b["n"], b["place"])
    sizes = plan.groupBy(F.col(b["source"]).alias(b["of"])).agg(F.first(b["a"]).alias(b["n"]))
    placed = placed.join(F.broadcast(sizes), F.col(source).eqNullSafe(F.col(b["of"])), "left")  # a row a source
    placed = placed.withColumn(b["place"], F.pmod(F.col("mix_block") - 1, F.col(b["n"])) + 1)
    placed = placed.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(b["source"])) & (F.col(b["place"]) == F.col(b["k"])), "left")  # a row a slot of the period
    turn = F.floor((F.col("mix_block") - 1) / F.col(b["n"]))
    slot = F.coalesce(turn * period + F.col(b["slot"]), F.lit((1 << 62) - 1)).cast("long")
    return placed.withColumn("mix_slot", slot).drop(*b.values())
