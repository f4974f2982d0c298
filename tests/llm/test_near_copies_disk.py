"""What the near-copy stage leaves on disk and sends through shuffles."""

import os

import pytest

from planwise.llm import nearcopies, shared
from planwise.llm.shared import materialize, maybe_among, scratch


def tables(folder):
    return sorted(name.rsplit("-", 1)[0] for name in os.listdir(folder))


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    return tmp_path


def test_only_the_result_stays_on_disk(spark, folder):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "quite another text of a few words"), (4, None), (4, None)]
    kept = nearcopies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert tables(folder) == ["copies-found"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_kept_tables_go_with_the_outer_scratch(spark, folder):
    with scratch(spark):
        with scratch(spark):
            kept = materialize(spark.range(3), "kept", keep=True)
            materialize(spark.range(3), "gone")
        assert tables(folder) == ["kept"] and kept.count() == 3
    assert tables(folder) == []
    materialize(spark.range(3), "outside")
    assert tables(folder) == ["outside"]


def test_texts_of_other_nodes_are_dropped_before_the_shuffle(spark):
    ids = spark.range(4000).selectExpr("id as node", "concat('text ', id) as text").union(spark.createDataFrame([(None, None)], "node long, text string"))
    met = spark.createDataFrame([(i,) for i in (0, 7, 3999)], "node long")
    marked = maybe_among(ids, "node", met, "maybe")
    assert marked.columns == ["node", "text", "maybe"] and marked.count() == 4001
    maybe = {r["node"] for r in marked.where("maybe").collect()}
    assert {0, 7, 3999} <= maybe and len(maybe) < 10
    assert sorted(r["node"] for r in nearcopies.texts_of(met, ids.union(ids)).collect()) == [0, 7, 3999]
    assert maybe_among(ids, "node", met.where("false"), "maybe").where("maybe").count() == 0
