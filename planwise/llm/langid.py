"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, lower case, every run of non-letters one blank. The n-grams of 1 to 3
characters that hold a letter fall into BUCKETS hashed bins. Training counts bins by language over
a bounded sample of the labelled rows, balanced by language; the log-probability matrix (BUCKETS x
languages, at most LANGUAGES) is broadcast, and scoring sums its entries batch by batch in numpy.

A null text and a text without letters are `und` with score 0, as all texts are where nothing was
learned. Texts are scored whole, in pieces of any number. Repeated rows get equal predictions. Rows
with a null language are not learned from. Other columns play no part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keyed_fraction

UNKNOWN = "und"
ORDERS, BUCKETS, LANGUAGES = (1, 2, 3), 1 << 14, 256
#: At most about so many labelled texts are learned from, shared out evenly among the languages.
SAMPLE = 20_000
#: Characters handled at a time.
PIECE = 1 << 20
#: Additive smoothing of a bin's count.
SMOOTHING = 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Letters as they are, runs of anything else one blank; a blank at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, np.uint32(32))
    padded = np.concatenate([np.array([32], np.uint32), points, np.array([32], np.uint32)])
    return padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]


def bins(points: np.ndarray, n: int) -> np.ndarray:
    """The bin of the n-gram that begins at each place; the lone blank's is left out by its own bin, BUCKETS."""
    h = np.zeros(len(points) - n + 1, np.uint32)
    for i in range(n):
        h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    out = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.where(points[: len(out)] == 32, BUCKETS, out) if n == 1 else out


def count_bins(text: str) -> np.ndarray:
    points, total = code_points(text), np.zeros(BUCKETS + 1, np.int64)
    for at in range(0, len(points), PIECE):
        for n in ORDERS:
            part = points[at : at + PIECE + n - 1]
            if len(part) >= n:
                total += np.bincount(bins(part, n), minlength=BUCKETS + 1)
    return total[:BUCKETS]


def balanced_sample(docs: DataFrame, key: str, label: str, sizes: dict[str, int], most: int) -> DataFrame:
    """About most rows at the most, an even share of each label or all it has; the same keys each time."""
    even = most / max(1, len(sizes))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(label) == name, F.lit(min(1.0, even / n))).otherwise(share)
    return docs.where(keyed_fraction(F.coalesce(F.col(key), F.lit(0)), share))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the matrix of log probabilities with the languages' log shares as its last row."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()}
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                totals[lang.as_py()] = totals.get(lang.as_py(), 0) + count_bins(text.as_py())
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bin", "n"])

    sample = balanced_sample(known, "id", "lang", shares, most).select("text", "lang")
    counts = sample.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(shares)
    matrix = np.zeros((BUCKETS, len(languages)))
    if languages:
        column = np.array([languages.index(x) for x in counts.column("lang").to_pylist()], np.int64)
        matrix[counts.column("bin").to_numpy(), column] = counts.column("n").to_numpy()
    matrix += SMOOTHING
    logs = np.log(matrix) - np.log(matrix.sum(0, keepdims=True))
    prior = np.log(np.array([[shares[x] for x in languages]], float) / max(1, sum(shares.values())))
    return languages, np.concatenate([logs, np.zeros_like(prior), prior]).astype(np.float32)


def score_texts(texts: list[str | None], languages: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    sums = np.zeros((len(texts), len(languages)))
    grams = np.zeros(len(texts), np.int64)
    points = [code_points(t) if t else np.empty(0, np.uint32) for t in texts]
    i = 0
    while i < len(points):
        j, size = i, 0
        while j < len(points) and (j == i or size + len(points[j]) <= PIECE):
            size += len(points[j])
            j += 1
        if size:
            owner = np.repeat(np.arange(i, j), [len(p) for p in points[i:j]])
            together = np.concatenate(points[i:j])
            for at in range(0, size, PIECE):
                for n in ORDERS:
                    part = together[at : at + PIECE + n - 1]
                    if len(part) < n:
                        continue
                    b, o = bins(part, n), owner[at : at + len(part) - n + 1]
                    if n > 1:  # an n-gram lies in one text
                        b = np.where(o == owner[at + n - 1 : at + n - 1 + len(o)], b, BUCKETS)
                    first, last = o[0], o[-1] + 1
                    grams[first:last] += np.bincount(o[b < BUCKETS] - first, minlength=last - first)
                    for k in range(len(languages)):
                        sums[first:last, k] += np.bincount(o - first, weights=matrix[b, k], minlength=last - first)
        i = j
    if not languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    total = sums + matrix[-1]
    best = total.argmax(1)
    gap = np.exp(np.clip(total - total.max(1, keepdims=True), -60, 0))
    share = gap.max(1) / gap.sum(1)
    seen = grams > 0
    return [languages[b] if s else UNKNOWN for b, s in zip(best, seen)], [float(p) if s else 0.0 for p, s in zip(share, seen)]


def identify(docs: DataFrame, languages: list[str], matrix: np.ndarray, text: str | Column = "text") -> Column:
    """A column of (lang_pred, score) for docs' texts."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), 512):
            a, b = score_texts(texts[at : at + 512].to_pylist(), *shared.value)
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)
