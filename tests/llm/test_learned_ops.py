import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwise.llm import langid, pii, queries, toxicity
from planwise.llm.shared import table

WIDER = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_the_composed_machine_sums_over_each_match_in_its_context():
    g, rnd = toxicity.Grammar({"idiot": 3.0, "moron*": 2.0, "no": 1.5, "you": 0.5}, np.zeros(5)), random.Random(1)

    def by_hand(words):
        target = any(w in toxicity.TARGET for w in words)
        out = [0.0, 0.0, 0.0]
        for i, w in enumerate(words):
            near = words[max(0, i - toxicity.REACH) : i]
            negated, reported = any(x in toxicity.NEGATION for x in near), any(x in toxicity.REPORT for x in near)
            factor = (toxicity.NEGATED if negated else 1.0) * (toxicity.REPORTED if reported else 1.0)
            if weight := g.insult(w):
                out[1 if negated or reported else 0] += weight * factor * (toxicity.TARGETED if target else 1.0)
            elif w in toxicity.THREAT and target and not negated:
                out[2] += toxicity.THREAT_WEIGHT * factor
        return out

    for _ in range(500):
        words = [rnd.choice("idiot morons no you kill said not tuer the a b c d e ihr".split()) for _ in range(rnd.randint(0, 14))]
        assert np.allclose(g.clause(words), by_hand(words)), words


def test_op6_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.op6_toxicity(spark, WIDER).collect()}
    assert len(rows) == table(spark, WIDER, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in rows.items())
    known = [(rows[r["doc_id"]], r["toxic"]) for r in table(spark, WIDER, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    y = np.array([t for _, t in known])
    assert auc(np.array([r["score"] for r, _ in known]), y) > 0.75
    assert all(r["predicted"] == 0 for r, t in known if t == 0)


def grammar():
    return toxicity.Grammar({"idiot": 4.0, "low*": 3.0}, np.array([-4.0, 1.0, 1.0, 0.3, 1.0]))


def test_clauses_weigh_by_context():
    g = grammar()
    plain, target, negated, reported = (g.clause(s.split())[:2] for s in ("an idiot", "you idiot", "not an idiot", "said an idiot"))
    assert target[0] > plain[0] > 0 and negated[0] == reported[0] == 0 and 0 < negated[1] < reported[1] < plain[0]
    assert g.clause("i will kill you".split())[2] > 0 == g.clause("kill time".split())[2]
    assert g.insult("lowei") == 3.0 and g.insult("flow") == 0.0
    score = g.score(np.array([g.features(t) for t in ("You idiot!", "nothing here", "", None, "x" * 100_000)]))
    assert score[0] > 0.5 > score[1] and len(set(score[1:])) == 1


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    for docs in (odd_docs, no_docs):
        g = toxicity.learn(docs, labels, F.lit(True))
        assert docs.select(toxicity.toxicity(docs, g).alias("s")).where("s between 0 and 1").count() == docs.count()
    g = toxicity.learn(odd_docs, labels.limit(0), F.lit(True))
    assert odd_docs.select(toxicity.toxicity(odd_docs, g).alias("s")).where("s < 0.001").count() == odd_docs.count()


def test_op8_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in table(spark, WIDER, "documents").collect()}
    rows = queries.op8_langid(spark, WIDER).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.97


def brute_log_likelihood(text, matrix):
    points = [c if c.isalpha() else " " for c in text.lower()]
    padded = re.sub(" +", " ", f" {''.join(points)} ")
    total = matrix[-1].astype(float)
    for n in langid.ORDERS:
        for i in range(len(padded) - n + 1):
            gram = np.array([ord(c) for c in padded[i : i + n]], np.uint32)
            total = total + matrix[langid.bins(gram, n)[0]]
    return total


def test_batches_score_as_single_texts_do(monkeypatch):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(langid.BUCKETS + 2, 3)).astype(np.float32)
    matrix[langid.BUCKETS] = 0
    texts = ["Ein Satz, zwei!", "", None, "123 %%", "été là-bas", "a", "long " * 50]
    for piece in (7, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        langs, scores = langid.score_texts(texts, ["x", "y", "z"], matrix)
        for t, l, s in zip(texts, langs, scores):
            if t and any(c.isalpha() for c in t):
                assert l == "xyz"[brute_log_likelihood(t, matrix).argmax()] and 0 <= s <= 1
            else:
                assert (l, s) == (langid.UNKNOWN, 0.0)
        assert np.array_equal(langid.count_bins("Ein Satz"), langid.count_bins("ein  satz"))


def test_langid_odd_rows(odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        languages, matrix = langid.learn(docs)
        found = docs.select("doc_id", langid.identify(docs, languages, matrix).alias("p")).collect()
        assert len(found) == docs.count()
        assert {r["p"]["lang_pred"] for r in found if r["doc_id"] in (3, 4, 6)} <= {langid.UNKNOWN}


TEXT = "Mr. John Smith (j.smith@mail1.example.com, J.Smith@mail1.example.com) and Frau Anna Berg; +1 (456) 555-2186, +1 456 555 2186, 4539578763621486, 23.17.61.190, 192.168.1.7, 123-45-6789, password=da6a7d4f67f2203943 token = \"be8a8e7152a5c568b612dc7f4042dd9566113270\" Herr Иван Петров, DE44 5001 0517 5407 3249 31"


def test_detection_types_and_canonical_values():
    found = [(k, v) for _, _, k, v in pii.detect(TEXT)]
    assert found == [
        ("given-m", "john"), ("surname", "smith"), ("email", "j.smith@mail1.example.com"), ("email", "j.smith@mail1.example.com"), ("given-f", "anna"), ("surname", "berg"), ("phone", "14565552186"), ("phone", "14565552186"),
        ("card", "4539578763621486"), ("ip", "23.17.61.190"), ("ip", "192.168.1.7"), ("ssn", "123456789"), ("secret", "da6a7d4f67f2203943"), ("secret", "be8a8e7152a5c568b612dc7f4042dd9566113270"),
        ("given-m", "иван"), ("surname", "петров"), ("iban", "DE44500105175407324931"),
    ]
    assert pii.detect(None) == pii.detect("") == pii.detect("no 12 numbers 3.14 here @ all = none: 10:30, 1,000") == []


def test_surrogates_keep_type_form_and_reference():
    new, spans = pii.rewrite(TEXT, b"k", {})
    assert not any(x in new for x in ("Smith", "smith@", "Berg", "555-2186", "4539578763621486", "23.17.61.190", "da6a7d4f", "Петров", "6789"))
    assert [s["kind"] for s in spans] == [k for _, _, k, _ in pii.detect(TEXT)] == [k for _, _, k, _ in pii.detect(new)]
    at = [new[s["start"] : s["end"]] for s in spans]
    assert at[2] == at[3].lower() and at[3][0].isupper() and at[2].endswith(".com")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", at[6]) and re.sub(r"\D", "", at[6]) == re.sub(r"\D", "", at[7])
    assert at[8][0] == "4" and pii.luhn(at[8]) == pii.luhn("4539578763621486") == 0
    assert at[10].startswith("192.168.") and re.fullmatch("[0-9a-f]{18}", at[12])
    assert all(pii.script(w) == "cyrillic" and w.istitle() for w in at[14:16]) and at[16][:2] == "DE" and pii.iban_check(at[16].replace(" ", "")) == 1
    assert pii.rewrite(TEXT, b"k", {})[0] == new != pii.rewrite(TEXT, b"other", {})[0]


def test_names_agree_across_titles_and_alone():
    new, spans = pii.rewrite("Dr Anna Smith met Mr Anna Smith. Smith left; Anna Smith too, a Smithy stayed. Mrs Smith-Berg", b"k", {})
    at = [new[s["start"] : s["end"]] for s in spans]
    assert [s["kind"] for s in spans] == ["given-m", "surname"] * 2 + ["surname", "given-m", "surname", "given-f", "surname"]
    assert at[0] == at[2] == at[5] and at[1] == at[3] == at[4] == at[6] and "Smithy" in new
    assert not re.search(r"\b(Anna|Smith|Berg)\b", new)


def test_what_only_looks_like_personal_data_stays():
    text = "card 4539578763621487, IBAN DE45 5001 0517 5407 3249 31, version 1.2.3.4, v10.0.0.1, password = something, token: SOMETHING"
    assert pii.detect(text) == [] and pii.rewrite(text, b"k", {})[0] == text
    assert [k for _, _, k, _ in pii.detect("host 1.2.3.4 password = s0mething")] == ["ip", "secret"]


def test_collisions_draw_again(spark):
    values = [f"{v:03}" for v in range(150)]
    firsts = spark.createDataFrame([("n", v, pii.surrogate(b"", "n", v)) for v in values], "kind string, value string, new string")
    settled = {r["value"]: r["new"] for r in pii.settle(firsts, b"").collect()}
    final = {r["value"]: settled.get(r["value"], r["new"]) for r in firsts.collect()}
    assert len(set(final.values())) == 150 and not set(final.values()) & set(final) and 0 < len(settled) < 150


def test_op9_replaces_every_entity_and_both_ways_agree(spark):
    docs = table(spark, WIDER, "documents").select("doc_id", "text")
    real = {v for r in docs.collect() for _, _, _, v in pii.detect(r["text"])}
    rows = queries.op9_pii(spark, WIDER).collect()
    assert len(rows) == docs.count() and sum(r["n_entities"] for r in rows) > 20
    assert not any(v in real for r in rows for _, _, _, v in pii.detect(r["text"]))
    by_join = pii.anonymize(docs, bound=-1).collect()
    assert sorted((r["doc_id"], r["text"]) for r in by_join) == sorted((r["doc_id"], r["text"]) for r in rows)


def test_pii_leaves_columns_of_any_name(spark):
    names = ["_r", "_d", "_own", "_digest", "_entities", "kind", "value", "new", "entities"]
    docs = spark.createDataFrame([("Mr John Smith", *range(len(names)))], ["text", *names])
    for bound in (10, -1):
        row = pii.anonymize(docs, bound=bound, entities_as=None).first()
        assert [row[c] for c in names] == list(range(len(names))) and "Smith" not in row["text"]


def test_pii_odd_rows(odd_docs, no_docs):
    found = pii.anonymize(odd_docs)
    assert set(odd_docs.columns) < set(found.columns)
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    assert {r["text"] for r in rows if r["doc_id"] in (3, 4, 6)} == {None, "", "\t \n"}
    assert pii.anonymize(no_docs).count() == 0


@pytest.mark.parametrize("value,check", [("4539578763621486", 0), ("4539578763621487", 1)])
def test_luhn(value, check):
    assert pii.luhn(value) == check
