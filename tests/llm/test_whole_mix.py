import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from planwise.llm import mixing
from planwise.llm.shared import table


def test_encoding_returns_the_mix(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").limit(150)
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/mixed")
    rows = corpus_pipeline.encode(spark, spark.read.parquet(f"file://{tmp_path}/mixed"), sf_dir).collect()
    places = [(r["mix_slot"], r["mix_offset"]) for r in rows]
    assert places == sorted(places) and len(rows) == 150 and all(r["ids"] is not None for r in rows)
    want = {r["doc_id"]: (r["mix_block"], r["mix_slot"], r["mix_offset"]) for r in mixing.schedule(docs).collect()}
    assert {r["doc_id"]: (r["mix_block"], r["mix_slot"], r["mix_offset"]) for r in rows} == want


def test_columns_of_any_name_stay(spark):
    names = ["k", "a", "slot", "_rank", "_one", "_md5", "_source", "n", "first", "source_", "of"]
    rows = [(i, "ab"[i % 2], f"text {i}", *range(len(names))) for i in (1, 2, 3, 3, 3)]
    docs = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    found = mixing.schedule(docs, block=1).collect()
    assert len(found) == 5 and all(r[c] == i for r in found for i, c in enumerate(names))
    assert len({(r["source"], r["mix_block"]) for r in found}) == 5


def test_more_sources_than_slots(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "cast(id as string) as source")
    slots = [r["mix_slot"] for r in mixing.schedule(docs, period=50).collect()]
    assert mixing.period_for(60, 50) == 150 and len(set(slots)) == 60 and max(slots) < 150
