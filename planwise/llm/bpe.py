"""BPE encoding and decoding with a given vocabulary of word pieces.

A word is a doubly linked list of symbols; a heap holds (rank, position) of every pair that has a
merge. The lowest rank merges first, the leftmost of equals; entries whose symbols have changed
since are stale and skipped. Decoding joins the vocabulary's strings.

Nulls and empty texts encode to no ids and decode to the empty string. Texts of any length are
encoded whole. Repeated rows give repeated results; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush, heappushpop
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits of the newest Unicode versions, which the tokenizers library still counts as neither.
NOT_YET_LETTERS = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    "\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3"
    "\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191"
    "\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    "\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    "\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
#: Capitals that the library lowers and Python does not yet.
NEW_LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)
#: What the pattern's white space is; str.split() also parts at U+001C to U+001F.
SPACES = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

#: Below this character letters and digits are as the library has them; texts of such characters only are parted into words in one go.
NARROW = 0x558
WIDE = re.compile(f"[\\u{NARROW:04x}-\U0010ffff]")
#: The pattern's white space below NARROW.
NARROW_SPACES = "\\t-\\r \\x85\\xa0"

#: Marks that the library, of an older Unicode version, neither reorders nor composes.
STARTERS = regex.compile(
    "[\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070"
    "\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99"
    "\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136"
    "\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef]"
)

#: Pieces of each generation of the memo; two generations are kept, of some 300 bytes a piece. A worker keeps them for all later stages.
MEMO = 100_000


class Memo(dict):
    """compute(key), remembered for the keys of the last two generations."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def composed(text: str) -> str:
    """Normalization form C as the library has it: starters of its own part the text."""
    if unicodedata.is_normalized("NFC", text) and not (WIDE.search(text) and STARTERS.search(text)):
        return text
    out, at = [], 0
    for m in STARTERS.finditer(text):
        out += [unicodedata.normalize("NFC", text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, unicodedata.normalize("NFC", text[at:])])


def narrow_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts without WIDE characters, its classes spelled out; the module re is several times faster."""
    for kind in ("\\p{L}", "\\p{N}"):
        pattern = pattern.replace(kind, "".join(re.escape(chr(c)) for c in range(NARROW) if regex.fullmatch(kind, chr(c))))
    return re.compile(pattern.replace("\\s", NARROW_SPACES))


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Reads a tokenizer file: vocabulary, merges, word-end mark, pattern of words, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        self.end = model["end_of_word_suffix"] or ""
        #: By rank: the pair that merges and what it becomes; by the pair's first and then its second: its rank. The last, empty one is of no symbol.
        self.merge = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(strings) + 2)]
        for rank, (a, b, _) in enumerate(self.merge):
            self.ranks[a][b] = rank
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        self.narrow_words = narrow_pattern(pattern).findall
        for kind in ("\\p{L}", "\\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{NOT_YET_LETTERS}]]")
        self.wide_word = regex.compile(pattern, regex.V1)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        symbols = byte_symbols()
        self.inner = [self.ids.get(symbols[b]) for b in range(256)]
        self.final = [self.ids.get(symbols[b] + self.end) for b in range(256)]
        self.packed = {i: i.to_bytes(4, "little") for i in strings}
        self.pieces = Memo(self.encode_piece, MEMO // 20)
        self.words = Memo(self.encode_word, MEMO - MEMO // 20)

    def encode_word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and their decoded text."""
        raw = word.encode("utf-8", "replace")
        inner = self.inner
        symbol = [inner[b] for b in raw]
        symbol[-1] = self.final[raw[-1]]
        if None in symbol:
            symbol = [s for s in symbol if s is not None]
        n, ranks, merge = len(symbol), self.ranks, self.merge
        shift = 10 if n < 1024 else n.bit_length()  # a heap entry is rank and position in one small integer
        place = (1 << shift) - 1
        symbol.append(-1)  # the neighbour beyond either end, which merges with none
        heap, after = [], ranks[-1]
        for i, b in enumerate(symbol, -1):
            if b in after:
                heap.append(after[b] << shift | i)
            after = ranks[b]
        heapify(heap)
        left, right = list(range(-1, n)), list(range(1, n + 1))
        live = len(heap)  # entries that are not stale
        while live:
            top = heappop(heap)
            while True:
                i = top & place
                a, b, new = merge[top >> shift]
                j = right[i]
                if symbol[i] != a or symbol[j] != b:
                    break  # stale
                symbol[i], symbol[j] = new, -1
                right[i] = k = right[j]
                left[k] = i
                h, c = left[i], symbol[k]
                before, after = ranks[symbol[h]], ranks[new]
                live += (new in before) - (a in before) + (c in after) - (c in ranks[b]) - 1
                if new in before:
                    if c in after:
                        heappush(heap, after[c] << shift | i)
                    top = heappushpop(heap, before[new] << shift | h)
                elif c in after:
                    top = heappushpop(heap, after[c] << shift | i)
                else:
                    break
        ids = [s for s in symbol if s >= 0]
        packed, strings = self.packed, self.strings
        return b"".join([packed[s] for s in ids]), " ".join([strings[s] for s in ids])

    def encode_piece(self, piece: str) -> tuple[bytes, str]:
        """The same of a piece between white space; its words are remembered by themselves too."""
        words = (self.word if piece.isascii() or max(piece) < "\u0558" else self.wide_word).findall(piece)
        if len(words) == 1:
            return self.words[words[0]]
        known = self.words
        parts = [known[w] for w in words]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        if self.special is None or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            i = self.specials[m[0]]
            out += [*self.plain(text[at : m.start()]), (i.to_bytes(4, "little"), self.strings[i])]
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii():
            text = composed(text)
            text = text.replace("Σ", "σ")  # lower case is by character: no final sigma
            if max(text) > "\u1c88":
                text = text.translate(NEW_LOWER)
        text = text.lower()
        if text.isascii() or not WIDE.search(text):
            return list(map(self.words.__getitem__, self.narrow_words(text)))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            pieces = [p for p in regex.split(SPACES, text) if p]
        else:
            pieces = text.split()
        return list(map(self.pieces.__getitem__, pieces))

    def encode_bytes(self, text: str | None) -> tuple[bytes, str]:
        parts = self.parts(text) if text else None
        if not parts:
            return b"", ""
        flat = list(chain.from_iterable(parts))
        return b"".join(flat[::2]), " ".join(filter(None, flat[1::2]))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_bytes(text)[0]).cast("I").tolist() if text else []

    def decode(self, ids) -> str:
        """The vocabulary's strings, word-end marks kept, joined as a tokenizer without a decoder joins them."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_ids(path: str):
    """A column function: text to its ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        t = tokenizer(path)
        raw = [t.encode_bytes(x.as_py())[0] for x in texts]
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    return ids


def bpe_text(path: str):
    """A column function: ids to text; null ids give null."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        t = tokenizer(path)
        return pa.array([None if x.as_py() is None else t.decode(x.as_py()) for x in ids], pa.string())

    return text


def bpe_digests(path: str):
    """A column function: text to the number of ids and the digests of the ids and of the decoded text."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        t, n, of_ids, of_text = tokenizer(path), [], [], []
        for x in texts:
            ids, decoded = t.encode_bytes(x.as_py())
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; no shuffle."""
    return docs.select("doc_id", bpe_digests(path)(F.col("text")).alias("_d")).select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
