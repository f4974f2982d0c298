"""Near copies by the Jaccard similarity of word shingles: all pairs of 4/5 or more, and no other, by fingerprints and then prefix filtering.

Operator 5 (`simhash.near_duplicates`) goes first: its covering tables join texts whose fingerprints are near. A text
and the least of its component are linked where their sets have 4/5. What fingerprints leave apart is met by prefixes.

A text's set holds the XXH64 values of its word shingles. Two sets with a similarity of 4/5 share at
least 4/5 of either, so in any order that holds for all sets they share one of the first n - ceil(4n/5) + 1
shingles of each, their prefixes: no pair is missed. The order takes shingles that a sample shows often
last, so that shared passages seldom make buckets; it decides how many pairs are met, not which are linked.

A node is a text, named by its hash; texts without words are one node. A bucket holds the nodes with
one shingle in their prefixes. In its order the first REACH + 1 nodes meet each other, all later ones the
first HUBS and the CHAIN before them: smaller buckets are then done. Larger ones are crowds: of what the links so far leave in
different components, every pair of a crowd meets for which it can be the first shingle that they share. A pair whose prefixes share too few shingles for 4/5
goes; what is left is held against the whole sets. Nothing about all documents reaches the driver but counts.

A shingle that the sample expects in more than CROWD prefixes is dealt to several buckets, which the
crowd's part joins; so no task sorts one shingle's nodes alone, however many texts have it.

Null texts and texts without words have the empty set, and are copies of each other. A text shorter
than a shingle is one shingle. Repeated rows are copies. Of a component the least doc_id stays, of equal ids
the least text hash; a row without an id stays only where no row of its component has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_skewed, keyed_fraction, materialize, maybe_among, scratch, slices
from .simhash import components, near_duplicates, shingle_hashes

#: The order's sample: this share of the texts, shingles seen so often in it, and so many of them at the most.
SHARE, OFTEN, COMMON = 1 / 8, 4, 20_000
#: The first nodes of a bucket meet REACH before them, later ones its first HUBS and CHAIN before them; expected nodes of a shingle beyond which its bucket is dealt to several.
REACH, HUBS, CHAIN, CROWD = 7, 2, 2, 100_000
#: Texts that a task remembers so as not to make their sets again.
SEEN = 500_000
#: Operator 5's shingles and bits, as its query has them.
FINGERPRINT_WIDTH, FINGERPRINT_BITS = 4, 4
#: The node of all texts without words; column names that no input has.
EMPTY, NODE, MAYBE = 0, "__copies_node", "__copies_maybe"


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted, each once; signed, as Spark's long has them."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def text_node(text: str) -> Column:
    """A text's own hash; EMPTY where it has no words."""
    return F.when(F.col(text).rlike(r"[^\x20\t-\r]"), F.xxhash64(text)).otherwise(F.lit(EMPTY).cast("long"))


def shingle_sets(width: int):
    """Of batches of node and text: node and hashes, the text's whole set."""

    def made(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), lists([shingle_set(t.as_py(), width) for t in batch.column(1)])], names=["node", "hashes"])

    return made


def common_shingles(docs: DataFrame, width: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several sampled texts, sorted, and their counts. Equal texts count once."""
    sampled = docs.where(keyed_fraction(F.col(text), F.lit(SHARE))).select(text_node(text), text).mapInArrow(shingle_sets(width), "node long, hashes array<long>")
    counts = sampled.dropDuplicates(["node"]).select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = sorted((r["h"], r["count"]) for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(hashes)
    if not n:
        return hashes
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))[: n - (4 * n + 4) // 5 + 1]]


def marked_rows(docs: DataFrame, width: int, doc_id: str, text: str, shared) -> DataFrame:
    """doc_id, node, n, prefix of every row; a text that its task has seen before has no prefix again."""

    def made(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            found = []
            for given, t in zip(batch.column(1).to_pylist(), batch.column(2)):
                hashes = np.empty(0, np.int64)
                if given not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    hashes = shingle_set(t.as_py(), width)
                    seen.add(given)
                found.append(hashes)
            sizes = pa.array([len(h) for h in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, lists([prefix(h, *shared.value) for h in found])], names=["doc_id", "node", "n", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text_node(text), text).mapInArrow(made, f"doc_id {kind}, node long, n int, prefix array<long>")


def alike_in_size(n: Column, m: Column) -> Column:
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def dealt(nodes: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """key, at (its place in the prefix, from 0), bucket, node, n: a row for every shingle of a prefix. hot: shingles whose nodes are dealt to several buckets, and to how many."""
    rows = nodes.select(F.posexplode("prefix").alias("at", "key"), "node", "n")
    deals = F.lit(1)
    for key, several in hot:
        deals = F.when(F.col("key") == key, F.lit(several)).otherwise(deals)
    bucket = F.when(deals > 1, F.xxhash64("key", F.pmod(F.xxhash64("node"), deals))).otherwise(F.col("key"))
    return rows.withColumn("bucket", bucket)


def first_meetings(rows: DataFrame) -> DataFrame:
    """a, b: pairs of nodes to hold against each other; and rows with a null b, whose a is the key of a bucket with more to meet."""
    order = Window.partitionBy("bucket").orderBy("node")
    one = F.struct("node", "n")
    here = rows.repartition("bucket").dropDuplicates(["bucket", "node"])
    here = here.withColumn("_place", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    hubs, before = [f"_hub{k}" for k in range(1, HUBS + 1)], [f"_{k}" for k in range(1, REACH + 1)]
    for k, name in enumerate(hubs, 1):
        here = here.withColumn(name, F.nth_value(one, k).over(so_far))
    for k, name in enumerate(before, 1):
        here = here.withColumn(name, F.lag(one, k).over(order))
    others = F.when(F.col("_place") <= REACH + 1, F.array(*before)).otherwise(F.array(*hubs, *before[:CHAIN]))
    met = F.filter(others, lambda x: x.isNotNull() & (x["node"] != F.col("node")) & alike_in_size(x["n"], F.col("n")))
    pairs = F.transform(F.array_distinct(met), lambda x: F.struct(x["node"].alias("a"), F.col("node").alias("b")))
    crowd = F.when(F.col("_place") == REACH + 2, F.array(F.struct(F.col("key").alias("a"), F.lit(None).cast("long").alias("b"))))
    return here.where("_place > 1").select(F.explode(F.concat(pairs, F.coalesce(crowd, F.array()))).alias("_p")).select("_p.*").distinct()


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose prefixes share so many shingles that 4/5 is possible.

    Of two prefixes let the first be the one that ends earlier in the order. What both sets share is in
    both prefixes, or beyond the first prefix in its own set: n - its length more at the most.
    """
    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"_n{c}"), F.col("prefix").alias(f"_p{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("_pa", "_pb")) + F.greatest(F.col("_na") - F.size("_pa"), F.col("_nb") - F.size("_pb"))
    return both.where(9 * shared >= 4 * (F.col("_na") + F.col("_nb"))).select("a", "b")


def texts_of(met: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text of the nodes met, each once. Texts of other nodes go before the shuffle, but for few."""
    few = maybe_among(texts, "node", met, MAYBE).where(MAYBE).select("node", "text")
    return few.join(met, "node", "left_semi").dropDuplicates(["node"]).select("node", "text")


def alike(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets have a similarity of 4/5 or more; written. texts: node, text, perhaps repeated. A text's set is made once."""
    spark = pairs.sparkSession
    with scratch(spark):
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = materialize(pairs.repartition(parts, "a", "b"), "copies-pairs")  # narrow rows; few files would be few tasks where the sets are broadcast
        met = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
        whole = materialize(texts_of(met, texts).mapInArrow(shingle_sets(width), "node long, hashes array<long>"), "copies-sets")
        one, two = (whole.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
        four_fifths = 9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b"))
        return materialize(pairs.join(one, "a").join(two, "b").where(four_fifths).select("a", "b"), "copies-links", keep=True)


def by_fingerprint(texts: DataFrame, width: int) -> DataFrame:
    """a, b: what operator 5 joins by fingerprints, each node with the least of its component, as far as their sets are alike too; written. texts: node, text, perhaps repeated; no text is shuffled for it."""
    joined = near_duplicates(texts.where(F.col("node") != EMPTY), FINGERPRINT_WIDTH, FINGERPRINT_BITS, "node")
    return alike(joined.where("component_id != doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct(), texts, width)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components. roots: node, root of the nodes that have one."""
    for c in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_r{c}")), c, "left")
    return pairs.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def open_crowds(there: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, n, at, root, home (in the crowd's largest component) of the crowds with several components; written. there: key, node, n, at."""
    there = there.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = there.groupBy("key", "root").agg(F.count("*").alias("c"))
    home = sizes.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("home"), F.count("*").alias("parts")).where("parts > 1").select("key", "home")
    return materialize(there.join(home, "key").withColumn("home", F.col("root") == F.col("home")), "copies-open")


def crowd_meetings(crowds: DataFrame) -> DataFrame:
    """a, b: the pairs of crowds, in different components, that may have a similarity of 4/5.

    The largest component of a crowd meets the others' nodes only, and these each other. What lies before the first shingle
    that two sets share is in one of them only; where that is too much on either side, the crowd is not their first shingle's,
    or they are no pair. A pair whose first shingle has a smaller bucket has met there.
    """
    out, all_ = crowds.where("not home").alias("o"), crowds.alias("m")
    apart = F.expr("o.key = m.key and o.root != m.root and (m.home or o.node < m.node) and 9 * (o.n - o.at) >= 4 * (o.n + m.n) and 9 * (m.n - m.at) >= 4 * (o.n + m.n)")
    return out.join(all_, apart).select(F.least("o.node", "m.node").alias("a"), F.greatest("o.node", "m.node").alias("b")).distinct()


def joined_by(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) of what the roots' stars and the pairs (a, b) join; written. Both are written."""
    if not pairs.limit(1).count():
        return roots
    return materialize(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(pairs)), "copies-roots")


def linked(marked: DataFrame, docs: DataFrame, width: int, text: str, shared) -> DataFrame:
    """(node, root) of all nodes that have a near copy. marked: as marked_rows gives it, written."""
    nodes = marked.where(F.size("prefix") > 0).select("node", "n", "prefix")
    once = nodes.dropDuplicates(["node"])
    texts = docs.select(text_node(text).alias("node"), F.col(text).alias("text"))
    hot = [(int(h), 1 + int(c / SHARE) // CROWD) for h, c in zip(*shared.value) if c / SHARE > CROWD]
    rows = dealt(nodes, hot)
    met = materialize(first_meetings(rows.drop("at")), "copies-met")
    joined = materialize(components(by_fingerprint(texts, width)), "copies-roots")
    roots = joined_by(joined, alike(promising(apart(met.where("b is not null"), joined), once), texts, width))
    crowds = met.where("b is null").select(F.col("a").alias("key"))
    if hot:
        crowds = crowds.union(marked.sparkSession.createDataFrame([(h,) for h, _ in hot], "key long"))
    there = materialize(rows.join(crowds.distinct(), "key").dropDuplicates(["key", "node"]).select("key", "node", "n", "at"), "copies-crowds")
    rest = materialize(promising(crowd_meetings(open_crowds(there, roots)), once), "copies-rest")
    return joined_by(roots, alike(rest, texts, width))


def copies(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, rows (how many have both), component, keeps (its component's winner), component_id: each pair of id and text once; written."""
    with scratch(docs.sparkSession):
        shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width, text))
        marked = materialize(marked_rows(docs, width, doc_id, text, shared), "copies-marked")
        roots = linked(marked, docs, width, text, shared)
        own = materialize(marked.groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "copies-own")
        often = own.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "n")
        often = materialize(often, "copies-often")
        placed = materialize(join_skewed(own, often, "node", "n").select("doc_id", "node", "rows", "component"), "copies-placed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
        winners = placed.groupBy("component").agg(first.alias("w"), F.count("*").alias("n")).select("component", F.col("w.doc_id").alias("component_id"), F.col("w.node").alias("_node"), "n")
        winners = materialize(winners, "copies-winners")
        keeps = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("_node"))
        return materialize(join_skewed(placed, winners, "component", "n").select("doc_id", "node", "rows", "component", keeps.alias("keeps"), "component_id"), "copies-found", keep=True)


def near_copies(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node and component_id, the least doc_id that pairs of a similarity of 4/5 or more reach: a row for each of docs."""
    found = copies(docs, width, doc_id, text)
    return found.select("doc_id", "node", "component_id", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_again")).drop("_again")


def without_near_copies(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies, with the columns of docs."""
    found = copies(docs, width, doc_id, text)
    gone = found.where("not keeps or rows > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    again = found.where("keeps and rows > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    here = maybe_among(docs.withColumn(NODE, text_node(text)), NODE, found.where("not keeps or rows > 1").select("node"), MAYBE)
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col(NODE) == F.col("_node"))
    single, perhaps = here.where(~F.col(MAYBE)), here.where(MAYBE)
    once = perhaps.join(gone, same, "left_anti")
    repeated = perhaps.join(again, same, "left_semi").dropDuplicates([doc_id, NODE])
    return single.unionByName(once).unionByName(repeated).drop(NODE, MAYBE)
