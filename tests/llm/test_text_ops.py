import hashlib
import random
import struct
import zlib
from html.parser import HTMLParser

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from planwise.llm import bpe, media, queries, warc
from planwise.llm.markup import SILENT, blocks
from planwise.llm.shared import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check_bpe(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text[:80]
    assert own.encode_bytes(text)[1] == own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_odd_texts(library):
    own, rnd = bpe.WordBpe(PATH), random.Random(1)
    odd = ["", "  ", "a\x1cb \x1d", "ΑΣ ΟΔΟΣ", "é ́x", "İstanbul", "don't I'll 'S", "½²Ⅷ٣", "hello<|endoftext|>World <|startoftext|>", "日本語 テスト", "a" * 5000, "\x85x y", "😀👍🏽", "՘Ᲊ"]
    odd += ["".join(rnd.choice("ab '\"sdtlrevem<|>endoftext |Σσς́é \n") for _ in range(50)) for _ in range(300)]
    odd += ["".join(chr(rnd.randrange(32, 0x600)) for _ in range(40)) for _ in range(300)]
    for text in odd:
        check_bpe(library, own, text)


def test_bpe_memos_do_not_change_results(library):
    own = bpe.WordBpe(PATH)
    own.pieces.size = 3
    for text in ("the thing in the thing", "one, two; one, two; three three one", "the thing in the thing"):
        check_bpe(library, own, text)


def test_bpe_equals_library_on_mixed_scripts(library):
    own, rnd = bpe.WordBpe(PATH), random.Random(5)
    spans = [(33, 127), (0xC0, 0x250), (0x370, 0x590), (0x300, 0x370), (0x591, 0x5BE), (0x898, 0x8E2), (0xEB8, 0xEBB), (0x1AB0, 0x1ACF), (0x900, 0xE00), (0x1100, 0x1300)]
    spans += [(0x1E00, 0x2000), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x10D00, 0x10D70), (0x11900, 0x11950), (0x1F600, 0x1F650), (9, 33)]
    for _ in range(3000):
        some = rnd.sample(spans, rnd.randint(1, 4))
        check_bpe(library, own, "".join(chr(rnd.randrange(*rnd.choice(some))) for _ in range(rnd.randint(0, 60))))


def test_op1_on_a_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_odd_rows(odd_docs, no_docs):
    rows = bpe.encode_documents(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (3, 4, 6)} == {(0, empty, empty)}
    assert bpe.encode_documents(no_docs, PATH).collect() == []


def test_op2_on_a_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op2_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] and r["pos"] == 1 and str(len(raw)) in r["caption"]


def test_png_round_trip_and_damage():
    for n in (0, 1, 575, 576, 577, 200_000):
        payload = media.payload_of("x" * n)
        stored = media.png(payload)
        assert len(payload) % 576 == 0 and payload and media.samples(stored).tobytes() == payload
    with pytest.raises(ValueError):
        media.samples(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


def test_items_keep_positions_and_captions():
    html = "<p>one</p><figure><img src='sha256:aa'><img src='sha256:bb' alt='b'><figcaption>both &amp; more</figcaption></figure>two<img src=sha256:cc alt=c><img src='http://x'>"
    assert [(i["pos"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.items(html)] == [
        (0, "text", "one", None, None), (1, "media", None, "aa", "both & more"), (2, "media", None, "bb", "both & more"), (3, "text", "two", None, None), (4, "media", None, "cc", "c"),
    ]
    assert media.items(None) == media.items("") == []


def test_sequences_resolve_by_digest(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:d1'><p>b</p><img src='sha256:none'>"), (2, None), (3, "<img src='sha256:d1'>")], "page long, html string")
    store = spark.createDataFrame([("d1", b"xy")], "digest string, payload binary")
    found = media.sequences(media.resolve(media.interleave(pages, ["page"], "html"), store), ["page"]).orderBy("page").collect()
    assert [[(i["pos"], i["text"], i["payload"] and bytes(i["payload"])) for i in r["items"]] for r in found] == [[(0, "a", None), (1, None, b"xy"), (2, "b", None), (3, None, None)], [(0, None, b"xy")]]


def test_op2_odd_rows(odd_docs, no_docs):
    store = media.media_store(odd_docs)
    assert store.count() == 8  # null, empty and the repeated row meet
    assert media.media_store(no_docs).count() == 0


class Plain(HTMLParser):
    """Visible text by the standard parser."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in SILENT or tag == "title"

    def handle_endtag(self, tag):
        self.off -= tag in SILENT or tag == "title"

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_op3_on_a_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in table(spark, sf_dir, "pages").collect()}
    rows = queries.op3_warc(spark, sf_dir).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        page = pages[r["page_id"]]
        html = page["html"].encode()
        assert r["source_payload_digest"] == warc.digest(html) and r["target_uri"] == page["url"]
        assert r["block_digest"] == warc.digest(r["body"].encode()) and r["n_bytes"] == len(r["body"].encode())
        assert warc.read_record(warc.response(page["url"], page["html"], "2024-01-01T00:00:00Z"))[0]["warc-record-id"] == r["refers_to"]
        if r["record_type"] == "conversion":
            plain = Plain()
            plain.feed(page["html"])
            plain.close()
            assert "".join(r["body"].split()) == "".join("".join(plain.words).split())
        else:
            assert f"source-payload-digest: {warc.digest(html)}" in r["body"] and "title: " in r["body"]


def test_warc_odd_records():
    for url, html in ((None, None), ("", ""), ("u\r\nX: y", "<a href='z'>t</a><script>no</script><!-- no -->")):
        records = warc.derive(warc.response(url, html, "d"))
        assert [r[0] for r in records] == ["metadata", "conversion"]
        for kind, own, refers, record in records:
            headers, block = warc.read_record(record)
            assert headers["warc-block-digest"] == warc.digest(block) and headers["warc-refers-to"] == refers and len(block) == int(headers["content-length"])
    assert block == b"t" and b"outlink: z" in records[0][3]
    assert warc.derive(warc.write_record([("WARC-Type", "warcinfo")], b"")) == []
    assert blocks("<p>a<b>b</b> &lt;c") == ["ab <c"]


def test_narrow_texts_are_parted_at_once_as_the_library_parts_them(library):
    own, rnd = bpe.WordBpe(PATH), random.Random(9)
    every = "".join(map(chr, range(1, bpe.NARROW)))
    texts = [every, " ".join(every), "a" * 3000 + ", " + "ab" * 2000, "it's 'sit' we'll'll", "Ⱥ Ⱦ"]
    texts += ["".join(rnd.choice(every) for _ in range(rnd.randint(1, 80))) for _ in range(500)]
    for text in texts:
        check_bpe(library, own, text)
    own = bpe.WordBpe(PATH)
    own.encode("alpha, beta; alpha. (beta)")
    assert len(own.pieces) == 0 and set(own.words) == {"alpha", "beta", ",", ";", ".", "(", ")"}
