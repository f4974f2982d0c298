import random
import sys
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from planwise.llm import nearcopies
from planwise.llm.shared import table


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """doc_id to the least id of its component: every pair of distinct sets is held against 0.8."""
    by = {}
    for d, t in docs:
        by.setdefault(shingles(t), []).append(d)
    sets = sorted(by, key=len)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i]) >= 4 * len(sets[j]):
            both = len(sets[i] & sets[j])
            if both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                near += 1
                root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(sets):
        ids = [d for d in by[s] if d is not None]
        if ids:
            least[find(i)] = min([*ids, *([least[find(i)]] if find(i) in least else [])])
    return sorted(((d, least.get(find(i))) for i, s in enumerate(sets) for d in by[s]), key=str), near


def as_found(docs):
    return sorted(((r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()), key=str)


@pytest.mark.parametrize("often", [4, 1])
def test_near_copies_are_those_of_four_fifths(spark, monkeypatch, often):
    monkeypatch.setattr(nearcopies, "OFTEN", often)
    rnd = random.Random(often)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for c in range(12):
        base = [f"w{c}x{rnd.randrange(10**6)}" for _ in range(rnd.randrange(60, 260))] + passage * (c % 3 == 0)
        for _ in range(12):  # from copies to some well below the threshold
            words = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 40)):
                words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
            rows.append((rnd.randrange(10**9), " ".join(words)))
    rows += [(1, None), (2, ""), (3, "Short one"), (4, "short ONE"), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    want, near = brute(rows)
    assert near > 100
    assert as_found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_near_copies_on_a_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert as_found(docs) == brute([tuple(r) for r in docs.collect()])[0]


def test_the_stage_links_at_four_fifths_and_not_below(spark, sf_dir):
    rnd = random.Random(7)
    rows = []
    for c in range(30):
        base = [f"c{c}w{i}" for i in range(104)]  # 100 shingles
        above, below = list(base), list(base)
        above[50] = above[10] = "x"  # 90 of 110 shared
        for at in (10, 40, 70):  # 85 of 115 shared
            below[at] = "y"
        rows += [(3 * c, " ".join(base)), (3 * c + 1, " ".join(above)), (3 * c + 2, " ".join(below))]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert kept == sorted([3 * c for c in range(30)] + [3 * c + 2 for c in range(30)])


def test_fingerprints_link_first(spark, sf_dir, monkeypatch):
    """The stage's links begin with those of operator 5, held against the whole sets; what they join is not met again."""
    calls = []
    own = nearcopies.near_duplicates

    def noted(docs, width, radius, doc_id="doc_id", text="text"):
        calls.append((width, radius))
        return own(docs, width, radius, doc_id, text)

    monkeypatch.setattr(nearcopies, "near_duplicates", noted)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(f"other{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == [1, 3]
    assert calls == [(4, 4)]
    texts = docs.select(nearcopies.text_node("text").alias("node"), "text")
    links = nearcopies.by_fingerprint(texts, 5)
    assert links.count() == 1
    assert nearcopies.apart(links, links.select(F.col("b").alias("node"), F.col("a").alias("root"))).count() == 0
