"""Arms without conflicts: none is beyond reach, and each rule of the choice holds, by brute force."""

import pytest

from planwise.operators import select
from planwise.registry import QUERIES


def simulate(arms, uses, budget, quota=6):
    """The choice one arm after the other, as the method says it. arms: id, tab, bytes, score. uses: query, tab, id, whole."""
    queries, whole = {}, {}
    for q, t, i, w in uses:
        queries.setdefault(i, set()).add((q, t))
        whole.setdefault(i, set()).update([(q, t)] if w else [])
    left, chosen, tables = sorted((a for a in arms if a[3] > 0), key=lambda a: (-a[3], a[0])), [], {}
    while left:
        i, tab, size, score = left.pop(0)
        if size > budget:
            continue
        budget -= size
        chosen.append(i)
        tables[tab] = tables.get(tab, 0) + 1
        for of in queries.values():
            of -= whole[i]
        left = [a for a in left if a[0].split(",")[0] != i.split(",")[0] and not (a[1] == tab and tables[tab] >= quota) and queries[a[0]] and not whole[a[0]] & whole[i]]
    return chosen


def chosen(spark, arms, uses, *args):
    scored = spark.createDataFrame(arms, "index_id string, tab string, size_bytes long, score double")
    rows = select.arms_without_conflicts(scored, spark.createDataFrame(uses, "query_id long, tab string, index_id string, whole boolean"), *args).collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["index_id"] for r in rows]


def test_an_arm_after_a_thousand_is_chosen(spark):
    arms = [("t#a", "t", 10, 9.0), *((f"t#a,c{k}", "t", 1, 8.0 - k / 1000) for k in range(1200)), *((f"u#d{k}", "u", 10**9, 5.0) for k in range(100)), ("t#b", "t", 10, 0.5), ("t#e", "t", 10, 0.0)]
    uses = [(q, i[0].split("#")[0], i[0], False) for q, i in enumerate(arms)]
    assert chosen(spark, arms, uses, 100) == ["t#a", "t#b"] == simulate(arms, uses, 100)


def test_rules_by_hand(spark):
    arms = [("t#a,b", "t", 1, 9.0), ("t#b,a", "t", 1, 8.0), ("t#b", "t", 1, 7.0), ("t#c", "t", 1, 6.0), ("u#a", "u", 1, 5.0), ("u#b", "u", 5, 4.0), ("u#c", "u", 1, 3.0)]
    # query 1 touches a and b of t, query 2 also c; query 3 touches b only
    uses = [(1, "t", "t#a,b", True), (1, "t", "t#b,a", True), (1, "t", "t#b", False), (2, "t", "t#a,b", False), (2, "t", "t#b,a", False), (2, "t", "t#c", False), (1, "u", "u#a", False), (1, "u", "u#b", False), (1, "u", "u#c", False)]
    assert chosen(spark, arms, uses, 6) == ["t#a,b", "t#c", "u#a", "u#c"]  # t#b,a is whole for query 1 too, t#b has no query left, u#b does not fit
    assert chosen(spark, arms, [*uses, (3, "t", "t#b", True)], 6) == ["t#a,b", "t#b", "t#c", "u#a", "u#c"]
    assert chosen(spark, arms, uses, 6, 1) == ["t#a,b", "u#a"]
    assert chosen(spark, arms, uses, 0) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_choice_is_the_one_made_one_after_the_other(spark, seed):
    names = [f"{t}#{','.join(c)}" for t in "tu" for c in ["a", "b", "c", "d", "e", "ab", "ba", "bc", "cb", "ac", "cd", "dc", "de", "ed", "ea"]]
    arms = [(i, i[0], 1 + (k * 37 * seed) % 11, round((k * 53 * seed) % 29 - 1.5, 1)) for k, i in enumerate(names)]
    uses = []
    for q, columns in enumerate(["a", "ab", "abc", "bc", "cd", "cde", "de", "eab"]):
        uses += [(q, i[0], i, len(own) == len(columns)) for i in names if (own := i[2:].split(",")) and set(own) <= set(columns) and (q * seed + ord(i[0])) % 3]
    known = {u[2] for u in uses}
    arms = [a for a in arms if a[0] in known]
    for budget in (12, 40, 400):
        assert chosen(spark, arms, uses, budget, 3) == simulate(arms, uses, budget, 3)


def test_registered_arms_follow_the_rules(spark, sf_dir):
    from planwise.operators.candidates import candidates_of, sized_of
    from planwise.operators.querylog import columns_of

    rows = sorted(QUERIES["select_ucb_arms"](spark, sf_dir).collect(), key=lambda r: r["place"])
    scores = {r["index_id"]: r["ucb"] for r in QUERIES["ucb_scores"](spark, sf_dir).collect()}
    arms = [(r["index_id"], r["tab"], r["size_bytes"], scores[r["index_id"]]) for r in sized_of(spark, sf_dir).collect()]
    uses = [tuple(r) for r in select.uses_of_arms(candidates_of(spark, sf_dir), columns_of(spark, sf_dir)).collect()]
    assert [r["index_id"] for r in rows] == simulate(arms, uses, select.budget(spark, sf_dir)) and rows and any(u[3] for u in uses)
