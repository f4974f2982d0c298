"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint holds, bit by bit, the majority of the XXH64 values (seed 42) of its word
shingles. For a radius r there are 2^(r+1)-1 tables; table v keeps the fingerprint's bits i with
odd parity of code(i) & v. Up to r differing bits pose r equations on the r+1 bits of v, so some
v > 0 solves them all, and in its table the two fingerprints are equal: no linked pair is missed.

Texts with equal fingerprints are one node. Buckets of two are compared in place; larger ones walk
breadth-first from fingerprint to fingerprint, each step against those not yet reached, and return
a star. Buckets beyond SPLIT nodes are dealt anew by another covering, to those that agree in its bits
too, up to LEVELS times; then 13 bits at most are open, so no bucket has more than 8192 nodes. Components come from alternating large-star and small-star steps. Nothing about all
documents reaches the driver but counts.

Null texts and texts without words have fingerprint zero and link like any other. A text shorter
than a shingle is one shingle. Repeated rows and equal texts fall into one component. A null doc_id
keeps its row and never is a component's id. Other columns play no part. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_skewed, materialize, partitions, slices

SEED, BITS = 42, 64
#: Larger buckets are dealt anew by another covering, of so many in all.
SPLIT, LEVELS = 4096, 4
#: Hashes that are unpacked to bits at a time.
UNPACKED = 1 << 15


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle; bytes.lower() and bytes.split() touch ASCII letters and white space only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Signed, as Spark's long has it."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), UNPACKED):
        part = hashes[i : i + UNPACKED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp of docs (doc_id, text). Texts pass through Python and do not wait for their result in the JVM."""

    def made(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), width) for x in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """One mask a table. Each level gives the codes to the bits in another keyed order.

    With more codes than bits the bits take the odd ones, so that no mask is empty; radius 6 is the most.
    """
    codes = 1 << (radius + 1)
    if codes > 2 * BITS:
        raise ValueError(f"no covering of {BITS} bits for radius {radius}")
    order = sorted(range(BITS), key=lambda i: hashlib.blake2b(bytes([level, i])).digest()) if level else range(BITS)
    code = {bit: (2 * i + 1) % codes if codes > BITS else i % codes for i, bit in enumerate(order)}
    return [signed(sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() & 1)) for v in range(1, codes)]


def reach(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(least of its component, node) for the nodes linked within one bucket."""
    left = np.unique(nodes)
    out = []
    while len(left) > 1:
        found, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            new = left[near]
            left = left[~near]
            found.extend(new)
            queue.extend(new)
        root = found[0]  # nodes are sorted, so the first is the least
        out.extend((int(root), int(x)) for x in found[1:])
    return out


def bucket_stars(radius: int):
    def stars(bucket: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(reach(bucket["fp"].to_numpy(np.int64), radius), columns=["a", "b"], dtype="int64")

    return stars


def tables(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(tab, kept, key, fp): every fingerprint in every table, with the bits that its key keeps. nodes may come dealt already."""
    if "tab" in nodes.columns:
        tab, kept = F.col("tab") * len(masks), F.col("kept")
    else:
        tab, kept = F.lit(0).cast("long"), F.lit(0).cast("long")
    keys = F.array(*[F.struct((tab + i).alias("tab"), kept.bitwiseOR(F.lit(m)).alias("kept")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(keys).alias("_k")).select("_k.tab", "_k.kept", F.col("fp").bitwiseAND(F.col("_k.kept")).alias("key"), "fp")


def buckets(dealt: DataFrame) -> DataFrame:
    """The buckets with company: their size, least and largest node. Counted before the shuffle and after."""
    return dealt.groupBy("tab", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")


def pairs(found: DataFrame, radius: int) -> DataFrame:
    return found.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")


def links(nodes: DataFrame, radius: int, split: int = SPLIT) -> DataFrame:
    """(a, b), a < b in each bucket's order: enough links within the radius to join what is linked. nodes: fp, each once."""
    dealt, out = nodes, None
    for level in range(LEVELS):
        dealt = tables(dealt, covering_masks(radius, level))
        found = materialize(buckets(dealt), "simhash-buckets")
        large = found.where(f"n > {split}").select("tab", "key") if level + 1 < LEVELS else found.where("false")
        small = found.where("n > 2").join(large, ["tab", "key"], "left_anti").select("tab", "key")
        walked = dealt.join(small, ["tab", "key"]).groupBy("tab", "key").applyInPandas(bucket_stars(radius), "a long, b long")
        both = pairs(found, radius).union(walked)
        out = both if out is None else out.union(both)
        if not large.limit(1).count():
            break
        dealt = materialize(dealt.join(large, ["tab", "key"]).select("tab", "kept", "fp"), "simhash-crowded")
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge but the least of its component, with that. edges: a, b, longs.

    Large-star hangs each node's larger neighbours on the least one, small-star its smaller ones;
    edges that are stars are the components, so no round has to confirm them. Each round is written, so lineage stays short.
    """

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    def large(now: DataFrame) -> DataFrame:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hung = both.join(least(both), "u").select("v", F.least("m", "u").alias("m"), "u")
        return hung.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))

    def small(now: DataFrame) -> DataFrame:
        up = now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        own = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))  # the least neighbour's row is the node's own
        return up.join(least(up), "u").select(F.col("m").alias("a"), own.alias("b"))

    def are_stars(now: DataFrame) -> bool:
        """Whether every b has one a, which is no b."""
        ends = now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("root")))
        of = ends.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("root").alias("below"), F.count("*").alias("n"))
        return not of.where("lo != hi or (below > 0 and below < n)").agg(F.count("*")).first()[0]

    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    now = materialize(now, "links")
    for _ in range(rounds):
        if are_stars(now):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct()
        now = materialize(small(large(now).distinct()), "stars")
    raise RuntimeError(f"components were not done after {rounds} rounds")


def near_duplicates(docs: DataFrame, width: int, radius: int, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """doc_id, fp (signed fingerprint) and component_id, the least doc_id that links reach."""
    spark = docs.sparkSession
    text = F.col(text) if isinstance(text, str) else text
    marked = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), text.alias("text")), width), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "nodes")
    roots = components(links(nodes.select("fp").repartition(partitions(spark), "fp"), radius))
    rooted = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    named = materialize(join_skewed(rooted.select("root", "fp", "rows"), ids, "root", "n").select("fp", "component_id", "rows"), "components")
    return join_skewed(marked, named, "fp", "rows").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
