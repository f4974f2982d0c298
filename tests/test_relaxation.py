"""Relaxation removes, cuts to prefixes, merges and splits; each step is the least penalty of all, by brute force."""

import math
from itertools import groupby, permutations

import pytest

from planwise.operators import select

ROWS = {"t": 100_000, "u": 50_000}
WIDTHS = {"a": 8.0, "b": 8.0, "c": 8.0, "x": 8.0, "y": 8.0, "z": 100.0}
#: query: table, frequency, and equality or range and selectivity by column
QUERIES = {1: ("t", 5, {"a": (True, 0.1), "b": (True, 0.2)}), 2: ("t", 1, {"b": (True, 0.2)}), 3: ("t", 3, {"c": (False, 0.3), "a": (True, 0.4)}), 4: ("u", 7, {"x": (True, 0.05)}), 5: ("u", 2, {"y": (False, 0.1)}), 6: ("u", 9, {"z": (True, 0.01)})}
START = {("t", ("a",)): [1], ("t", ("b",)): [1, 2], ("t", ("c",)): [3], ("t", ("c", "a")): [3], ("u", ("x", "z")): [4], ("u", ("y", "z")): [5]}


def name(i):
    return f"{i[0]}#{','.join(i[1])}"


def size(i):
    texts = i[1].count("z")
    return math.ceil(ROWS[i[0]] * (6 + sum(WIDTHS[c] for c in i[1]) + 2 + (2 + 2 * texts if texts else 0)))


def access(q, i):
    tab, _, by = QUERIES[q]
    if tab != i[0] or i[1][0] not in by:
        return math.inf
    sel = 1.0
    for c in i[1]:
        if c not in by:
            break
        sel *= by[c][1]
        if not by[c][0]:
            break
    return round(math.log2(ROWS[tab] + 1) + 2 * sel * ROWS[tab], 4)


def cost(chosen):
    return sum(f * min([ROWS[t], *(access(q, i) for i in chosen)]) for q, (t, f, _) in QUERIES.items())


def outcomes(chosen):
    for i in chosen:
        yield chosen - {i}
        for n in range(1, len(i[1])):
            yield chosen - {i} | {(i[0], i[1][:n])}
    for (s, a), (t, b) in permutations(chosen, 2):
        if s == t:
            rest = chosen - {(s, a), (t, b)}
            yield rest | {(s, (a + tuple(c for c in b if c not in a))[:2])}
            if set(a) & set(b):
                parts = [c for c in a if c in b], [c for c in a if c not in b], [c for c in b if c not in a]
                yield rest | {(s, tuple(p)) for p in parts if p}


def penalty(old, new, over):
    rise, saved = round(cost(new) - cost(old), 4), sum(map(size, old)) - sum(map(size, new))
    return math.inf if saved <= 0 else rise * saved if rise < 0 else rise / min(saved, over)


@pytest.mark.parametrize("budget", [0, 3_000_000, 8_000_000])
def test_each_step_is_the_least_penalty_of_all_relaxations(spark, budget):
    ids = {name((t, p)): (t, p) for t in ROWS for n in (1, 2) for p in permutations([c for c in WIDTHS if (c in "abc") == (t == "t")], n)}
    sized = spark.createDataFrame([(name(i), i[0], list(i[1]), size(i)) for i in START], "index_id string, tab string, cols array<string>, size_bytes long")
    scans = spark.createDataFrame([(q, t, float(ROWS[t])) for q, (t, *_) in QUERIES.items()], "query_id long, tab string, scan double")
    accesses = spark.createDataFrame([(q, i[0], name(i), access(q, i)) for i, qs in START.items() for q in qs], "query_id long, tab string, index_id string, icost double")
    weights = spark.createDataFrame([(q, f) for q, (_, f, _) in QUERIES.items()], "query_id long, freq long")
    stats = spark.createDataFrame([("t" if c in "abc" else "u", c, ROWS["t" if c in "abc" else "u"], w, None if c == "z" else 0.0) for c, w in WIDTHS.items()], "tab string, col string, rows long, width double, lo double")
    selectivity = spark.createDataFrame([(q, t, c, e, s) for q, (t, _, by) in QUERIES.items() for c, (e, s) in by.items()], "query_id long, tab string, col string, eq boolean, sel double")
    rows = sorted(select.select_relaxation(sized, scans, accesses, weights, stats, selectivity, budget).collect(), key=lambda r: r["step"])
    chosen = frozenset(START)
    for _, of in groupby(rows, key=lambda r: r["step"]):
        of = list(of)
        over = sum(map(size, chosen)) - budget
        assert over > 0
        new = chosen - {ids[r["index_id"]] for r in of} | {ids[m] for m in of[0]["made"].split(";") if m}
        best = min(penalty(chosen, frozenset(o), over) for o in outcomes(chosen))
        assert of[0]["score"] == pytest.approx(best, rel=1e-6, abs=1e-6) and penalty(chosen, new, over) == pytest.approx(best)
        assert of[0]["cost"] == pytest.approx(cost(new), abs=0.01)
        chosen = new
    assert sum(map(size, chosen)) <= budget
    done = {(r["change"], r["made"]) for r in rows}
    assert ("merging", "t#a,c") in done and ("splitting", "u#x;u#y;u#z") in done
