"""The registered selection queries start from every candidate with a gain and run to their stop rule."""

from collections import defaultdict

import pytest

from planwise.operators import select
from planwise.registry import QUERIES


@pytest.fixture(scope="module")
def world(spark, sf_dir):
    frames = tuple(d.cache() for d in select.inputs(spark, sf_dir))
    sized, scans, accesses, weights = (d.collect() for d in frames)
    freq = {r["query_id"]: r["freq"] for r in weights}
    base = {(r["query_id"], r["tab"]): r["scan"] for r in scans if r["query_id"] in freq}
    costs = defaultdict(dict)
    for r in accesses:
        if (r["query_id"], r["tab"]) in base:
            costs[r["index_id"]][r["query_id"], r["tab"]] = r["icost"]
    return frames, {r["index_id"]: r["size_bytes"] for r in sized}, freq, base, costs, select.budget(spark, sf_dir)


def cost(world, chosen):
    _, _, freq, base, costs, _ = world
    return sum(freq[k[0]] * min([c, *(costs[i][k] for i in chosen if k in costs[i])]) for k, c in base.items())


def gaining(world):
    none = cost(world, [])
    return {i for i in world[4] if none - cost(world, [i]) > 1e-6}


@pytest.fixture
def registered(spark, sf_dir, world, monkeypatch):
    monkeypatch.setattr(select, "inputs", lambda *_: world[0])
    return lambda name: QUERIES[name](spark, sf_dir).collect()


def test_drop_starts_from_all(world, registered):
    left = gaining(world)
    for r in sorted(registered("select_drop"), key=lambda r: r["step"]):
        best = min(cost(world, left - {i}) for i in left) - cost(world, left)
        assert r["index_id"] in left and r["score"] == pytest.approx(best, abs=0.01)
        left.remove(r["index_id"])
    assert len(left) == 8


def test_relaxation_starts_from_all(world, registered):
    left, sizes = gaining(world), world[1]
    whole = len(left)
    rows = sorted(registered("select_relaxation"), key=lambda r: r["step"])
    for r in rows:
        assert sum(sizes[i] for i in left) > world[5] and r["index_id"] in left | {i for i in sizes if any(j.startswith(i + ",") for j in gaining(world))}
        left.discard(r["index_id"])
    assert whole > 12 and {r["index_id"] for r in rows} | left >= gaining(world) and len(rows) > 12


def test_anytime_seeds_with_all_that_fit_and_ends_when_nothing_gains(world, registered):
    rows, sizes, gain = registered("select_anytime"), world[1], gaining(world)
    assert {r["seed"] for r in rows} == {"", *(i for i in gain if sizes[i] <= world[5])}
    for r in rows:
        own = [i for i in r["indexes"].split(";") if i]
        now, room = cost(world, own), world[5] - sum(sizes[i] for i in own)
        assert room >= 0 and r["cost"] == pytest.approx(now, abs=0.01)
        assert not any(sizes[i] <= room and now - cost(world, [*own, i]) > 1e-3 for i in gain)


def test_extend_ends_by_budget_or_gain(spark, world, registered):
    rows = registered("select_extend")
    assert [tuple(r) for r in rows] == [tuple(r) for r in select.select_extend(*world[0], world[5], most=100).collect()]
    chosen, sizes, used = set(), world[1], 0
    for r in sorted(rows, key=lambda r: r["step"]):
        parent = r["index_id"].rpartition(",")[0]
        used += sizes[r["index_id"]] - sizes.get(parent, 0)
        chosen = chosen - {parent} | {r["index_id"]}
    now = cost(world, chosen)
    for i in sizes:
        parent = i.rpartition(",")[0]
        if i not in chosen and (not parent or parent in chosen) and used + sizes[i] - sizes.get(parent, 0) <= world[5]:
            assert cost(world, [*chosen, i]) >= now / 1.003 * 0.999999
