"""Toxicity: a linear classifier whose scores are held still when identity terms are swapped.

Features are hashed words and word beginnings. Which of them count, and their weights, are decided on a bounded
sample of labelled rows: weights by logistic loss, a ridge, and a penalty on the squared change of the score
between a labelled sentence and its counterfactuals, in which identity terms are swapped for others of their
kind. So a term that neutral and toxic sentences share by accident gains no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import bucket_of, cut, labelled_sample, session, table

#: Kinds of identity terms; a term is swapped for others of its kind and number. A parameter of fit().
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that the model is fitted on at most. keep: features kept at most, by their
    likelihood-ratio statistic. least: rows that a feature is in at least."""

    sample: int = 20_000
    keep: int = 8_192
    least: int = 5
    statistic: float = 12.0
    ridge: float = 0.02
    counterfactual: float = 1.0
    positive_weight: float = 2.0
    steps: int = 300
    threshold: float = 0.7


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, in 40 bits."""
    out = [word] + [f"{word[:k]}\n" for k in PREFIXES if len(word) > k]
    return [xxhash.xxh3_64_intdigest(x) >> 24 for x in out]


class _Words(dict):
    """What each word maps to; cleared when large."""

    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


_FEATURES = _Words(word_features, 30_000)


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        out.update(_FEATURES[w])
    return out


def counterfactuals(text: str | None, terms: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """Pairs of a sentence with identity terms and a copy with each swapped for the next of its kind."""
    swap = {t: g[(i + 1) % len(g)] for g in terms for i, t in enumerate(g)}
    out = []
    for m in SENTENCE.finditer((text or "").lower()):
        s = m.group()
        t = WORD.sub(lambda w: swap.get(w.group(), w.group()), s)
        if t != s:
            out.append((s, t))
    return out


@dataclass(frozen=True)
class Model:
    """index: places of features. pairs: sentences with identity terms, each with its counterfactual, that the
    weights were held still on; 0 means that the penalty had nothing to act on."""

    index: dict[int, int]
    weights: np.ndarray
    bias: float
    threshold: float
    pairs: int = 0


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): the rows of either label that each feature is in. Feature -1 is in every row."""
    schema = "feature long, pos long, neg long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = np.array(b.column("y").to_pylist(), dtype=np.int64)
            sets = [[*features(t), -1] for t in b.column("text").to_pylist()]
            f, back = np.unique(np.concatenate([np.array(s, dtype=np.int64) for s in sets]), return_inverse=True)
            at = np.repeat(y, [len(s) for s in sets])
            pos = np.bincount(back, weights=at, minlength=len(f)).astype(np.int64)
            yield batch_of(schema, {"feature": f, "pos": pos, "neg": np.bincount(back, minlength=len(f)) - pos})

    return rows.mapInArrow(run, schema).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _likelihood_ratio(pos: Column, neg: Column, n1: int, n0: int) -> Column:
    """G statistic of a feature's presence against the label."""
    n = n1 + n0
    def term(o: Column, e: Column) -> Column:
        return F.when(o > 0, o * F.log(o / e)).otherwise(0.0)

    k = pos + neg
    rows = [(pos, k * n1 / n), (neg, k * n0 / n), (F.lit(n1) - pos, (F.lit(n) - k) * n1 / n), (F.lit(n0) - neg, (F.lit(n) - k) * n0 / n)]
    return 2 * sum((term(o.cast("double"), F.greatest(e, F.lit(1e-9))) for o, e in rows), F.lit(0.0))


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.array(r, dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def fit_weights(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, s: Settings) -> tuple[np.ndarray, float]:
    """Minimizes the mean weighted logistic loss + ridge / (2 rows) |w|^2 + counterfactual * mean (w.(f - f'))^2 by Adam."""
    col, row = _csr(rows)
    pcol, prow = _csr([[*a, *b] for a, b in pairs])
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs] or [np.zeros(0)])
    weight = np.where(y == 1, s.positive_weight, 1.0)
    weight = weight / weight.sum()
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    for t in range(1, s.steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, weights=e[row], minlength=size), e.sum())
        g[:-1] += s.ridge / len(rows) * w[:-1]
        if pairs:
            d = np.bincount(prow, weights=sign * w[pcol], minlength=len(pairs))
            g[:-1] += 2 * s.counterfactual / len(pairs) * np.bincount(pcol, weights=sign * d[prow], minlength=size)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fits on documents (doc_id, text) that labels (id, y) knows. Rows with a null id or with a y that is neither
    0 nor 1 are left out; a null text is an empty one, and of a long text every word and sentence counts. Where
    ids repeat on either side, every pairing of a text with a label is a row. With one label only, or none, the
    model gives that label's share, or one half, to every text."""
    session(docs.sparkSession)
    rows = cut(labelled_sample(docs, labels.where("y in (0, 1)").select("id", F.col("y").cast("int").alias("y")), settings.sample))
    counts = cut(_counts(rows))
    both = counts.where("feature = -1").first()
    if both is None or not both["pos"] or not both["neg"]:
        share = 0.5 if both is None else (both["pos"] + 0.5) / (both["pos"] + both["neg"] + 1)
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))), settings.threshold)
    g = _likelihood_ratio(F.col("pos"), F.col("neg"), both["pos"], both["neg"])
    chosen = counts.where((F.col("feature") >= 0) & (F.col("pos") + F.col("neg") >= settings.least)).withColumn("g", g).where(F.col("g") >= settings.statistic)
    index = {r["feature"]: i for i, r in enumerate(chosen.orderBy(F.desc("g"), "feature").limit(settings.keep).select("feature").collect())}
    schema = "y int, f array<int>, a array<int>, b array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda t: sorted(index[x] for x in features(t) if x in index)
        for batch in batches:
            y, f, a, b = [], [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                y.append(label)
                f.append(known(text))
                a.append([])
                b.append([])
                for s, t in counterfactuals(text, terms):
                    y.append(None)
                    f.append([])
                    a.append(known(s))
                    b.append(known(t))
            yield batch_of(schema, {"y": y, "f": f, "a": a, "b": b})

    # only feature numbers reach the driver, of at most `sample` rows
    data = rows.mapInArrow(run, schema).collect()
    own = [r for r in data if r["y"] is not None]
    pairs = [(r["a"], r["b"]) for r in data if r["y"] is None]
    w, bias = fit_weights([r["f"] for r in own], np.array([r["y"] for r in own]), pairs, len(index), settings)
    return Model(index, w, bias, settings.threshold, len(pairs))


def _scorer(m: Model):
    """The logit of a text, with what each word adds remembered."""
    found = _Words(lambda w: tuple(m.index[x] for x in word_features(w) if x in m.index))

    def logit(text: str | None) -> float:
        hit: set[int] = set()
        for w in set(WORD.findall((text or "").lower())):
            if at := found[w]:
                hit.update(at)
        return m.bias + (float(m.weights[sorted(hit)].sum()) if hit else 0.0)

    return logit


def _probability(logits: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -30, 30)))


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted) for whole texts; null and empty texts get the score of no features. Null
    ids and repeated rows come back as often as they occur, other columns are ignored, and of an empty table there
    are no rows."""
    session(docs.sparkSession)
    schema = "doc_id long, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = _scorer(m)
        for b in batches:
            p = _probability([logit(t) for t in b.column("text").to_pylist()])
            yield batch_of(schema, {"doc_id": b.column("doc_id"), "score": p, "predicted": (p >= m.threshold).astype(np.int32)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score stays below the model's threshold; each row is judged
    by its own text, whatever its id."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = _scorer(m)
        for b in batches:
            p = _probability([logit(t) for t in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(p < m.threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 3) == 1


def fit_tables(docs: DataFrame, labels: DataFrame, held: Column | None = None) -> Model:
    """Fits on documents with a toxic label, but for rows that are held out."""
    own = labels.where(~(held_out(F.col("doc_id")) if held is None else held))
    return fit(docs, own.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32 modulo 3 is 1 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    m = fit_tables(docs, table(spark, sf_dir, "labels"))
    return score(docs, m).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
