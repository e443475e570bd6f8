"""Quality: a cumulative-link (proportional-odds) regression of ordered grades on hashed text features.

All grades share one weight vector; ordered thresholds cut its score into grades. The expected grade ranks
documents, the probability of the upper grades selects them.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import U64, bucket_of, labelled_sample, mix, session, table


@dataclass(frozen=True)
class Settings:
    """sample: graded rows that weights are fitted on at most (the first by a hash of their ids)."""

    bits: int = 13
    sample: int = 20_000
    ridge: float = 1e-4
    steps: int = 250
    rate: float = 0.05
    keep_at: float = 0.5


_RUNS = re.compile(r"(.)\1+")


class _Signs(dict):
    """For str.translate: letters by case, digits as 9, other characters as they are."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        out = self[code] = ord("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c)
        return out


_SIGNS = _Signs()


def _shape(word: str) -> str:
    """Letters by case, digits as 9, other characters as they are; runs once."""
    return _RUNS.sub(r"\1", word.translate(_SIGNS))


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


_known_hash = lru_cache(maxsize=50_000)(_hash)


class _Words(dict):
    """Numbers of words, under which arrays have each word's key, its shape's key and its length. All is forgotten
    when it grows large, so memory is bounded."""

    most, most_chars = 150_000, 4_000_000

    def __init__(self) -> None:
        self.keys_, self.shapes, self.lengths, self.chars = array("Q"), array("Q"), array("Q"), 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.keys_.append(_hash(f"word {word.lower()}"))
        self.shapes.append(_known_hash(f"shape {_shape(word)}"))
        self.lengths.append(len(word))
        self.chars += len(word)
        return n

    def of(self, words: Collection[str]) -> list[np.ndarray]:
        """Keys, keys of shapes and lengths of words."""
        if len(self) > self.most or self.chars > self.most_chars:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return [np.frombuffer(x, dtype=U64)[at] if len(at) else np.zeros(0, dtype=U64) for x in (self.keys_, self.shapes, self.lengths)]


_WORDS = _Words()
#: What is added to a key for each level of its share; the lowest is on for any share.
LEVELS = 12
_LEVEL_KEYS = np.arange(LEVELS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)


def _steps(name: str, share: float) -> list[str]:
    """A share as cumulative tokens, one for each power of two that it reaches."""
    return [f"{name}>={k}" for k in range(1, LEVELS + 1) if share >= 2.0 ** (k - LEVELS - 1)]


def tokens(text: str | None, n: int, counts: Counter, chars: int) -> list[str]:
    """What is hashed of a whole text of n words besides its words and shapes: shares of repetition, and length."""
    out = [f"len>={k}" for k in range(20) if n >= 2**k]
    if not n:
        return [*out, "empty"]
    out += _steps("distinct", len(counts) / n) + _steps("commonest", max(counts.values()) / n)
    lines = Counter(x for x in text.split("\n") if x.strip())
    out += _steps("repeated lines", 1 - len(lines) / max(1, sum(lines.values())))
    out += [f"word length>={k}" for k in range(1, 25) if chars / n >= k]
    return out


def _shares(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all keys, one for each level that their share of n reaches: the lowest, and k from 1 to LEVELS
    where the share is 2 ** (k - LEVELS - 1) or more."""
    reached = np.clip(np.frexp(counts / n)[1] + LEVELS, 0, LEVELS) + 1
    first = np.cumsum(reached) - reached
    level = np.arange(int(reached.sum())) - np.repeat(first, reached)
    return mix(np.repeat(keys, reached) + _LEVEL_KEYS[level])


def hashed(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: all its words and shapes count, wherever they stand."""
    words = (text or "").split()
    counts = Counter(words)
    keys, shapes, length = _WORDS.of(counts)
    times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    h = np.array([_known_hash(t) for t in tokens(text, len(words), counts, int(length.astype(np.int64) @ times))], dtype=U64)
    if words:
        distinct, at = np.unique(shapes, return_inverse=True)
        h = np.concatenate([h, _shares(keys, times, len(words)), _shares(distinct, np.bincount(at, weights=times), len(words))])
    h >>= U64(64 - bits)
    if bits > 16:
        return np.unique(h).astype(np.uint32)
    on = np.zeros(1 << bits, dtype=bool)
    on[h.astype(np.int64)] = True
    return np.flatnonzero(on).astype(np.uint16)


@dataclass(frozen=True)
class Model:
    """P(grade <= grades[k]) = logistic(cuts[k] - weights . features)."""

    grades: tuple[float, ...]
    weights: np.ndarray
    cuts: np.ndarray
    bits: int

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None] - z[:, None], -30, 30)))
        edges = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
        return np.diff(edges, axis=1)


def _blocks(rows: Sequence[Sequence[int] | np.ndarray], n: np.ndarray, most: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that have features, about `most` of these at a time, so that what a step computes stays small:
    (features, row numbers, where each row begins)."""
    own = np.flatnonzero(n)
    cuts = np.flatnonzero(np.diff(np.cumsum(n[own]) // most)) + 1
    return [(np.concatenate([np.asarray(rows[k]) for k in x]), x, np.cumsum(n[x]) - n[x]) for x in np.split(own, cuts) if len(x)]


def fit_weights(rows: Sequence[Sequence[int] | np.ndarray], y: np.ndarray, grades: tuple[float, ...], s: Settings) -> Model:
    """Maximum likelihood with a ridge, by Adam. y: positions in grades. Thresholds are kept in order by
    being written as a first one and positive gaps."""
    size, k = 1 << s.bits, len(grades)
    n = np.array([len(r) for r in rows], dtype=np.int64)
    blocks = _blocks(rows, n)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    if k == 1 or not len(rows):
        return Model(grades, np.zeros(size), cuts[: k - 1], s.bits)
    norm = 1 / np.sqrt(np.maximum(n, 1))
    p = np.concatenate([np.zeros(size), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, s.steps + 1):
        gaps = np.exp(p[size + 1 :])
        cuts = p[size] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.zeros(len(rows))
        for col, own, starts in blocks:
            z[own] = np.add.reduceat(p[col], starts) * norm[own]
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = sig(edge[y + 1] - z), sig(edge[y] - z)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        q = np.maximum(hi - lo, 1e-12)
        gz = (d_hi - d_lo) / q / len(rows)  # of the negative log-likelihood
        g = np.zeros_like(p)
        g[:size] = s.ridge * p[:size]
        for col, own, _ in blocks:
            g[:size] += np.bincount(col, weights=np.repeat(gz[own] * norm[own], n[own]), minlength=size)
        gc = np.zeros(k - 1)
        np.add.at(gc, np.minimum(y, k - 2), np.where(y < k - 1, -d_hi / q / len(rows), 0))
        np.add.at(gc, np.maximum(y - 1, 0), np.where(y > 0, d_lo / q / len(rows), 0))
        g[size] = gc.sum()
        g[size + 1 :] = gaps * np.cumsum(gc[::-1])[::-1][1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(grades, p[:size], p[size] + np.concatenate([[0], np.cumsum(np.exp(p[size + 1 :]))]), s.bits)


def fit(docs: DataFrame, grades: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fits on documents (doc_id, text) that grades (id, y) knows; grades are numbers, of any number of levels.
    Rows with a null id or grade teach nothing; where ids repeat on either side, every pairing of a text with a
    grade counts. With no graded document at all there is one grade, 0."""
    session(docs.sparkSession)
    rows = labelled_sample(docs, grades.select("id", F.col("y").cast("double").alias("y")), settings.sample)
    bits, schema = settings.bits, "y double, f binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(schema, {"y": b.column("y"), "f": [hashed(t, bits).tobytes() for t in b.column("text").to_pylist()]})

    data = rows.mapInArrow(run, schema).collect()  # feature numbers of at most `sample` rows
    levels = tuple(sorted({r["y"] for r in data})) or (0.0,)
    at = {g: i for i, g in enumerate(levels)}
    return fit_weights([np.frombuffer(r["f"], dtype=np.uint16 if bits <= 16 else np.uint32) for r in data], np.array([at[r["y"]] for r in data], dtype=np.int64), levels, settings)


def score(docs: DataFrame, m: Model, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, expected_grade, tail_probability, kept): the mean of the grade's distribution, the
    probability of the upper half of the grades, and whether that is at least keep_at.

    Null and empty texts are scored as empty ones. Null ids and repeated rows come back as often as they occur,
    other columns are ignored, and of an empty table there are no rows."""
    upper = np.arange(len(m.grades)) >= max(1, len(m.grades) // 2) if len(m.grades) > 1 else np.array([True])
    schema = "doc_id long, expected_grade double, tail_probability double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [hashed(t, m.bits) for t in b.column("text").to_pylist()]
            p = m.probabilities(np.array([m.weights[x].sum() / np.sqrt(max(len(x), 1)) for x in f], dtype=np.float64))
            tail = p[:, upper].sum(axis=1)
            yield batch_of(schema, {"doc_id": b.column("doc_id"), "expected_grade": p @ np.array(m.grades), "tail_probability": tail, "kept": tail >= keep_at})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 3) == 1


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grades of all documents; rows whose crc32 modulo 3 is 1 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    own = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    m = fit(docs, own.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")))
    return score(docs, m).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")
