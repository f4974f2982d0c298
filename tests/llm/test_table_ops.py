import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from planwise.llm import chat, mixing, queries, simhash, topk
from planwise.llm.shared import table


# --- op4


def brute_chat(rows):
    """conv_id to (n_turns, digest of turns, loss characters, digest of loss)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def as_found(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_op4_on_a_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    control = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    assert as_found(queries.op4_chat(spark, sf_dir)) == brute_chat(rows)


@pytest.mark.parametrize("budget,history", [(10, 4), (40, 40), (1000, 100)])
def test_chat_windows_on_odd_rows(spark, budget, history):
    rnd = random.Random(budget)
    rows = [(c, t, rnd.choice(["user", "assistant"]) if t else "system", rnd.choice(["", "~0~1", "<|im_end|>\n", "[INST] a", "é😀" * rnd.randrange(40), "x" * rnd.randrange(300)])) for c in range(6) for t in range(rnd.randrange(1, 30))]
    rows += [(7, 0, None, None), (7, None, "assistant", "first"), (8, 1, "assistant", "tie"), (8, 1, "assistant", "tie"), (None, 0, "user", "nobody's"), (9, 5000, "assistant", "far"), (9, 1, "user", "near")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit("clash"))
    shown = chat.windows(given, budget, history)
    assert as_found(chat.digests(shown)) == brute_chat(rows)
    for w in shown.collect():
        bodies = [b for b in w["formatted"].split(chat.END) if b]
        assert all(b.startswith(chat.START) for b in bodies)
        sizes = [math.ceil(len(b + chat.END) / 4) for b in bodies]
        own = sizes[w["repeats"] :]
        assert sum(own[:-1]) <= budget  # the last turn begins within the budget
        first_system = bool(w["repeats"]) and bodies[0].startswith(chat.START + "system\n")
        assert sum(sizes[first_system : w["repeats"]]) <= history
    assert chat.digests(chat.windows(given.limit(0))).count() == 0


# --- op5


def brute_fingerprint(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """prints: [(doc_id, fingerprint)]; each row's least reachable id."""
    nodes = sorted({p for _, p in prints})
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            r = find(p)
            least[r] = min(least.get(r, d), d)
    return [(d, p, least.get(find(p))) for d, p in prints]


def order(rows):
    return sorted(rows, key=str)


def test_op5_on_a_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    want = brute_components([(d, brute_fingerprint(t, 4)) for d, t in docs], 4)
    found = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op5_simhash(spark, sf_dir).collect()]
    assert order(found) == order(want)
    assert any(d != c for d, _, c in want)


def test_op5_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute_components([(d, brute_fingerprint(t, 4)) for d, t in docs], 4)
    found = simhash.near_duplicates(odd_docs, 4, 4).collect()
    assert order((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == order(want)
    assert simhash.near_duplicates(no_docs, 4, 4).count() == 0


@pytest.mark.parametrize("radius", [1, 4, 5, 6])
@pytest.mark.parametrize("level", [0, 1, 3])
def test_covering_masks_miss_no_pair(level, radius):
    masks = [m % (1 << 64) for m in simhash.covering_masks(radius, level)]
    rnd = random.Random(level)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 24
    for _ in range(3000):
        difference = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, radius + 1)))
        assert any(difference & m == 0 for m in masks)


@pytest.mark.parametrize("split", [4, 5000])
def test_links_join_what_is_near(spark, split):
    rnd = random.Random(split)
    centers = [rnd.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for c in centers for _ in range(40)}
    prints |= {centers[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 4, split)).collect()}
    groups = defaultdict(set)
    for p in prints:
        groups[roots.get(simhash.signed(p), simhash.signed(p))].add(p)
    want = defaultdict(set)
    for p, _, c in brute_components([(p, p) for p in prints], 4):
        want[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_all_levels_leave_few_bits_open():
    kept = {0}
    for level in range(simhash.LEVELS):
        kept = {k | m % (1 << 64) for k in kept for m in simhash.covering_masks(4, level)}
    assert 64 - min(k.bit_count() for k in kept) <= 13


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200) if i != 100] + [(-5, -5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert roots == {i: 0 if i <= 100 else 101 for i in range(1, 201) if i != 101}


# --- op7


def edf(shares, period):
    """Slots of one period by plain simulation; shares: [(source, a)] in order."""
    nxt, out = {s: 1 for s, _ in shares}, []
    for t in range(period):
        ready = [(-(-nxt[s] * period // a), (nxt[s] - 1) * period // a, i, s) for i, (s, a) in enumerate(shares) if (nxt[s] - 1) * period // a <= t]
        out.append(min(ready)[3])
        nxt[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 90, "b": 9, "c": 1}, {"a": 7, "b": 5, "c": 3, "d": 2, "e": 2}])
def test_template_is_pfair(spark, weights):
    period = 100
    share = mixing.shares(spark.createDataFrame(list(weights.items()), "source string, weight long"), period)
    a = {r["source"]: r["a"] for r in share.collect()}
    assert sum(a.values()) == period
    slots = [r["source"] for r in mixing.template(share, period).orderBy("slot").collect()]
    assert slots == edf(sorted(a.items()), period)
    for t in range(1, period + 1):
        for s, w in a.items():
            assert abs(slots[:t].count(s) - Fraction(w * t, period)) < 1


def test_op7_on_a_table(spark, sf_dir):
    rows = queries.op7_mixing(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").collect()
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter(map(tuple, docs))
    sizes = Counter(d["source"] for d in docs)
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append((hashlib.md5(str(d["doc_id"]).encode()).hexdigest(), d["doc_id"]))
    place = {d: (s, i // 64 + 1, i % 64) for s, ids in by.items() for i, (_, d) in enumerate(sorted(ids))}
    assert all(place[r["doc_id"]] == (r["source"], r["mix_block"], r["mix_offset"]) for r in rows)
    assert len({r["mix_slot"] for r in rows}) == sum(-(-n // 64) for n in sizes.values())


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.schedule(odd_docs, block=1).collect()
    assert len(rows) == odd_docs.count() and {"text", "score", "mix_slot"} <= set(rows[0].asDict())
    assert len({r["mix_slot"] for r in rows}) == len(rows)
    given = spark.createDataFrame([("a", 3), ("b", 1), ("absent", 4)], "source string, weight long")
    rows = mixing.schedule(odd_docs, given, block=1).collect()
    assert len(rows) == odd_docs.count()
    late = {r["source"] for r in rows if r["mix_slot"] == (1 << 62) - 1}
    assert late == {"c", None}
    assert mixing.schedule(no_docs).count() == 0


# --- op10


def test_op10_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_topk"]).fetchall()
    found = queries.op10_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize("shape", [(3000, 8, 1.0), (500, 64, 0.1), (40, 3, 0.001), (2500, 4, 1e9)])
def test_lists_give_the_exact_best(shape):
    n, d, scale = shape
    rng = np.random.default_rng(n)
    x = np.floor(1024 * scale * rng.normal(size=(n, d)))
    x[::3] = x[0]  # ties
    ids = np.arange(n) * 10
    run = topk.Running(ids[:30], x[:30], 10)
    for at in range(0, n, 700):
        topk.read_lists(ids[at : at + 700], x[at : at + 700], run)
    whole = x.astype(np.int64) @ x[:30].astype(np.int64).T
    for q in range(min(30, n)):
        rows = sorted(((-whole[i, q], ids[i]) for i in range(n) if i != q))[:10]
        assert [(-s, v) for s, v in rows] == [tuple(r) for r in run.best[q]]


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (100, [-1.0, 0.0]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (0, 1, 1, 1024 * 1024 + 512 * 512), (0, 2, 1, 1024 * 1024 + 512 * 512), (0, 3, 100, -1024 * 1024),
        (100, 1, 0, -1024 * 1024), (100, 2, 1, -1024 * 1024), (100, 3, 1, -1024 * 1024), (200, 1, 7, 1024 * 1024),
    ]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
