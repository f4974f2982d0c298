"""What Python workers hold: long texts' sets go on in small batches, memos that stay with a worker are small."""

import pyarrow as pa

from planwise.llm import bpe, nearcopies, simhash


def test_sets_of_texts_are_handed_on_in_slices():
    n = 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"a b c d e f {i}" for i in range(n)])], names=["node", "text"])
    found = list(nearcopies.shingle_sets(5)(iter([batch])))
    assert len(found) > 1 and max(b.num_rows for b in found) <= 256
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(n))
    assert [x for b in found for x in b.column(1).to_pylist()] == [nearcopies.shingle_set(f"a b c d e f {i}", 5).tolist() for i in range(n)]


def test_repeated_texts_link_once(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words, "more"])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(nearcopies.text_node("text").alias("node"), "text")
    assert nearcopies.by_fingerprint(texts, 5).count() <= 1
    prints = simhash.fingerprints(docs, 4)
    assert "ArrowEvalPython" not in prints._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["fp"] for r in prints.collect()} == {d: simhash.fingerprint(t, 4) for d, t in rows}


def test_the_memo_that_a_worker_keeps_is_small():
    assert 2 * bpe.MEMO * 300 <= 64_000_000
