"""Interpolated modified Kneser-Ney model of any order from 2: counted in Spark, kept as sorted hash arrays that workers map.

Counting and merging move arrays, not rows. Words come first: each task folds its texts into sorted word hashes
with counts, shards of these are merged and written into the folder that all executors share, and every word gets a
number, small for frequent words. A second pass folds texts into n-grams of the highest order, as columns of word
numbers, and sends them to the shard of their context, where counts and all that the context gathers are complete.
Below the highest order an n-gram counts as often as different words stand before it, or, where it begins a text, as
often as it occurs; so lower orders follow from the next higher one, and only beginnings are counted themselves.
Scoring tasks map the arrays and look up 64-bit keys.

Columns travel sorted, as differences and byte by byte, compressed; arrays keep a key's upper 16 bits by position.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import U64, bucket_of, cut, hash_words, mix, release, session, shared_dir, table

#: Hash of the end of a text, which is a token. No word has white space.
END = U64(xxhash.xxh3_64_intdigest(b"\n"))
#: The number of a word that training has not seen. The begin of a text, only a context, has the one after all words.
UNKNOWN = 2**32 - 1
#: Tokens that a task scores, and that it counts, at once.
AT_ONCE, FOLD = 500_000, 4_000_000
#: Tokens whose n-grams make a shard, bytes of text whose words do, and training words whose contexts are spread over shards.
SHARD_TOKENS, SHARD_BYTES, FREQUENT = 2_000_000, 64 << 20, 2_000_000
#: Words are counted by powers of two of their counts, to be numbered from frequent to rare.
CLASSES = 64


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers besides them. files: the arrays that were written; a worker that
    misses one of them raises."""

    path: str
    word_shards: int
    shards: int
    train_tokens: int
    vocabulary: int
    first: tuple[tuple[int, ...], ...]  # number of the first word of each shard and class
    files: frozenset[str]
    frequent: int
    discounts: tuple[tuple[float, float, float], ...] = ()  # of orders 2, 3 and so on
    low_discounts: tuple[float, float, float] = (0.5, 0.75, 0.9)
    low_total: int = 0
    low_kinds: tuple[int, int, int] = (0, 0, 0)

    @property
    def order(self) -> int:
        return len(self.discounts) + 1


# --- arrays on disk and in transit ------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's arrays, so the shared folder must be mounted; it is {url.scheme}://")
    path = os.path.join(url.path, f"quern-lm-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of each row of word numbers."""
    k = np.full(len(columns[0]), len(columns), dtype=U64)
    for c in columns:
        k = mix((k + U64(0x9E3779B97F4A7C15)) ^ (c.astype(U64) * U64(0xD6E8FEB86659FD93)))
    return k


def _save(path: str, **arrays: np.ndarray) -> None:
    """Writes each array whole or not at all; a task that runs again writes the same."""
    for name, x in arrays.items():
        tmp = f"{path}.{name}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            np.save(f, x)
        os.replace(tmp, f"{path}.{name}.npy")


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in the smallest unsigned type that holds them."""
    most = int(counts.max(initial=0))
    return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def _parted(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys as the arrays that _find reads: where each value of the upper 16 bits begins, and the rest."""
    at = np.concatenate([[0], np.cumsum(np.bincount((keys >> U64(48)).astype(np.int64), minlength=1 << 16))])
    return {"at": _narrow(at), "high": (keys >> U64(32)).astype(np.uint16), "low": keys.astype(np.uint32)}


def _find(a: dict[str, np.ndarray], want: np.ndarray) -> np.ndarray:
    """Places of keys in _parted arrays, -1 where they are not, by bisection among the keys with equal upper bits."""
    at, high, low = a["at"], a["high"], a["low"]
    if not len(high):
        return np.full(len(want), -1)
    top, rest = (want >> U64(48)).astype(np.int64), want & U64((1 << 48) - 1)
    first, end = at[top].astype(np.int64), at[top + 1].astype(np.int64)
    of = lambda k: high[k].astype(U64) << U64(32) | low[k]
    before = first - 1  # the last place known to hold less
    for bit in reversed(range(int((end - first).max(initial=0)).bit_length())):
        k = before + (1 << bit)
        less = k < end
        less &= of(np.minimum(k, len(high) - 1)) < rest
        before += less.astype(np.int64) << bit
    k = before + 1
    return np.where((k < end) & (of(np.minimum(k, len(high) - 1)) == rest), k, -1)


PIECES = "kind int, shard long, n long, data binary"
#: Kinds of pieces: words; n-grams of the highest order, and those of spread contexts; beside these, n-grams of order m
#: with their counts, and what contexts of m words gather. Statistics have negative kinds.
WORDS, GRAMS, SPREAD, COUNTS, CONTEXTS = 0, 1, 2, 100, 200


def _packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted columns of 32-bit numbers and counts: the first column as differences, all by byte planes."""
    planes = [np.diff(columns[0].astype(np.uint32), prepend=np.uint32(0)), *columns[1:]]
    raw = [p.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for p in planes]
    return zstandard.compress(b"".join([*raw, np.ascontiguousarray(_narrow(counts).T).tobytes()]), 1)


def _unpacked(data: bytes, n: int, width: int, per: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What _packed took: `width` columns and `per` counts a row."""
    raw = zstandard.decompress(data)
    planes = [np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=4 * n * k).reshape(4, n).T.copy().view("<u4").ravel() for k in range(width)]
    size = (len(raw) - 4 * n * width) // (n * per)
    counts = np.frombuffer(raw, dtype=f"<u{size}", offset=4 * n * width).reshape(per, n).T.astype(np.int64)
    return [np.cumsum(planes[0], dtype=np.uint32), *planes[1:]], counts[:, 0] if per == 1 else counts


def _pieces(kind: int, columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """One row for each shard, of sorted rows; they stay sorted."""
    order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
    ids, at = np.unique(shard[order], return_index=True)
    rows = np.split(order, at[1:]) if len(ids) else []
    return pd.DataFrame({"kind": kind, "shard": ids, "n": [len(r) for r in rows], "data": [_packed([c[r] for c in columns], counts[r]) for r in rows]}).astype({"kind": "int32", "shard": "int64", "n": "int64"})


def _joined(pdf: pd.DataFrame, width: int, per: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """All rows of pieces, sorted and distinct, with the sums of their counts."""
    parts = [_unpacked(d, n, width, per) for d, n in zip(pdf["data"], pdf["n"], strict=True)]
    if not parts:
        return [np.zeros(0, np.uint32)] * width, np.zeros((0, per) if per > 1 else 0, np.int64)
    return _distinct([np.concatenate([p[0][k] for p in parts]) for k in range(width)], np.concatenate([p[1] for p in parts]))


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None = None, bits: int = 32) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows and the sums of their counts (of ones, if there are none). Columns are taken in one by
    one: the rank of what stands left of a column, and the column, make one 64-bit number that sorts as the rows do.
    Rows without counts whose numbers have so few bits that all fit into one number are sorted once."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64) if counts is None else counts
    if counts is None and bits * len(columns) <= 64:
        code = columns[0].astype(U64)
        for c in columns[1:]:
            code = code << U64(bits) | c
        code, total = np.unique(code, return_counts=True)
        return [(code >> U64(bits * k) & U64((1 << bits) - 1)).astype(np.uint32) for k in reversed(range(len(columns)))], total
    code, ranked = columns[0].astype(U64), []
    for k, c in enumerate(columns[1:]):
        if k:
            known, code = np.unique(code, return_inverse=True)
            ranked.append(known)
            code = code.astype(U64)
        code = code << U64(32) | c
    if counts is None:
        code, total = np.unique(code, return_counts=True)
    else:
        code, _, back = _groups(code)
        total = np.stack([np.bincount(back, weights=x, minlength=len(code)) for x in (counts.T if counts.ndim > 1 else counts[None])], axis=-1).astype(np.int64)
        total = total if counts.ndim > 1 else total[:, 0]
    out = []
    for _ in columns[1:]:
        out.append(code.astype(np.uint32))
        code = code >> U64(32)
        if len(out) < len(columns) - 1:
            code = ranked.pop()[code.astype(np.int64)]
    return [code.astype(np.uint32), *reversed(out)], total


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and for every key the number of its like."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


def _stats(kind: int, shard: int, numbers: list[int], files: str = "") -> pd.DataFrame:
    """A row of statistics, of kind -1 - kind, and the name of the arrays that were written."""
    return pd.DataFrame({"kind": [-1 - kind], "shard": [shard], "n": [len(numbers)], "data": [np.array(numbers, dtype=np.int64).tobytes() + files.encode()]}).astype({"kind": "int32", "shard": "int64", "n": "int64"})


# --- counting ---------------------------------------------------------------------------------------------


def _hashes(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Hashes of the words of texts, each with the end."""
    return [np.append(h, END) for h in hash_words(texts)]


def _folds(batches: Iterator[pd.DataFrame], most: int = FOLD) -> Iterator[list[np.ndarray]]:
    """Word hashes of texts, each with the end, about `most` tokens at a time."""
    held, size = [], 0
    for pdf in batches:
        held += (new := _hashes(pdf["text"].tolist()))
        size += sum(map(len, new))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _halves(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> U64(32)).astype(np.uint32), keys.astype(np.uint32)]


def _whole(halves: list[np.ndarray]) -> np.ndarray:
    return halves[0].astype(U64) << U64(32) | halves[1]


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def _count_words(texts: DataFrame, path: str, shards: int) -> DataFrame:
    """Writes the words' arrays; statistics: tokens, words, and words of each class."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _folds(batches):
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield _pieces(WORDS, _halves(keys), n, _shard(keys, shards))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, n = _joined(pdf, 2)
        shard, kind = int(pdf["shard"].iloc[0]), _classes(n)
        place = np.empty(len(n), dtype=np.int64)  # among the words of its class here
        order = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=CLASSES)
        place[order] = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _save(f"{path}/w-{shard}", **_parted(_whole(columns)), counts=_narrow(n), place=_narrow(place))
        return _stats(WORDS, shard, [n.sum(), len(n), *sizes], f"w-{shard}")

    return texts.mapInPandas(count, PIECES).groupBy("shard").applyInPandas(merge, PIECES)


def _numbered(sizes: dict[int, np.ndarray], shards: int) -> tuple[tuple[int, ...], ...]:
    """The number of the first word of each shard and class, frequent classes first."""
    table_ = np.zeros((shards, CLASSES), dtype=np.int64)
    for shard, x in sizes.items():
        table_[shard] = x
    flat = table_[:, ::-1].T.ravel()  # class by class, within it shard by shard
    first = (np.cumsum(flat) - flat).reshape(CLASSES, shards).T[:, ::-1]
    return tuple(tuple(int(v) for v in row) for row in first)


def _padded(held: list[np.ndarray], ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of texts, a begin before each; and for each place how many follow to its text's end, itself included."""
    size = np.array([len(h) + 1 for h in held])
    first = np.cumsum(size) - size
    p = np.full(size.sum(), begin, dtype=np.uint32)
    p[np.delete(np.arange(len(p)), first)] = ids
    return p, np.repeat(first + size, size) - np.arange(len(p))


def _spread(counts: np.ndarray, rows: np.ndarray, words: int, most: int) -> np.ndarray:
    """Whether contexts that begin at rows may have so many followers that they are spread: all words are frequent."""
    return np.min([counts[rows + k] for k in range(words)], axis=0) > most


def _count_grams(texts: DataFrame, m: Model, order: int) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _lookup(m)
        for held in _folds(batches):
            known, seen, rank = look.words(np.concatenate(held))
            p, left = _padded(held, rank, len(known))  # places of words here, which are in the order of their numbers
            known = np.append(known, np.uint32(m.vocabulary))
            c = np.append(np.minimum(seen, UNKNOWN), UNKNOWN)[p]  # a begin is as frequent as can be
            rows = np.flatnonzero(left >= order)
            hot = _spread(c, rows, order - 1, m.frequent)
            for kind, own in ((GRAMS, rows[~hot]), (SPREAD, rows[hot])):
                columns, n = _distinct([p[own + k] for k in range(order)], bits=len(seen).bit_length())
                columns = [known[x] for x in columns]
                yield _pieces(kind, columns, n, _shard(_key(columns if kind == SPREAD else columns[:-1]), m.shards))
            starts = np.flatnonzero(np.concatenate([[True], left[1:] > left[:-1]]))
            for k in range(2, order):
                columns, n = _distinct([known[p[starts[left[starts] >= k] + j]] for j in range(k)])
                yield _pieces(COUNTS + k, columns, n, _shard(_key(columns), m.shards))

    return texts.mapInPandas(count, PIECES)


def _gathered(columns: list[np.ndarray], c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of sorted n-grams, what contexts gather: the sum of the counts, and how many of these are 1, 2, and 3 or more."""
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns[:-1]], axis=0)]) if len(c) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(new)
    stats = [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (c, c == 1, c == 2, c >= 3)]
    return [x[at] for x in columns[:-1]], np.stack(stats, axis=1)


def _coded(stats: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of statistics as numbers of the distinct ones."""
    _, at, code = _groups(_key(list(stats.T)))
    return {"code": _narrow(code), "table": stats[at]}


def _below(columns: list[np.ndarray], shards: int) -> pd.DataFrame:
    """The n-grams without their first words, each counted once for every different one."""
    rest, n = _distinct(columns[1:])
    return _pieces(COUNTS + len(rest), rest, n, _shard(_key(rest), shards))


def _number_of(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _followers(columns: list[np.ndarray], c: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of sorted n-grams by their contexts: the contexts' sorted keys and what they gather; in the same order
    the last words with counts. first: where a context's words begin, from `base` of its upper 16 bits on."""
    contexts, stats = _gathered(columns, c)
    keys, n = _key(contexts), stats[:, 1:].sum(axis=1)
    by_key = np.argsort(keys)
    keys, begin, n = keys[by_key], (np.cumsum(n) - n)[by_key], n[by_key]
    first = np.cumsum(n) - n
    rows = np.arange(len(c)) + np.repeat(begin - first, n)
    word = columns[-1][rows]
    parted = _parted(keys)
    base = np.append(first, len(c))[parted["at"].astype(np.int64)]
    return {
        **parted, **_coded(stats[by_key]), "base": _narrow(base), "first": _narrow(first - base[(keys >> U64(48)).astype(np.int64)]),
        "word_high": _narrow(word >> np.uint32(16)), "word_low": word.astype(np.uint16), "times": _narrow(c[rows]),
    }


def _merge_top(pieces: DataFrame, path: str, shards: int, order: int) -> DataFrame:
    """Writes contexts of the highest order with the words that follow them; n-grams of spread contexts are written by
    their own keys, and what these contexts gather is sent on. Beginnings pass through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, out = int(pdf["shard"].iloc[0]), [pdf[pdf["kind"] > COUNTS]]
        own, hot = (_joined(pdf[pdf["kind"] == k], order) for k in (GRAMS, SPREAD))
        numbers = [x + y for x, y in zip(_number_of(own[1]), _number_of(hot[1]), strict=True)]
        out.append(_stats(order, shard, numbers))
        if len(own[1]):
            _save(f"{path}/{order - 1}-{shard}", **_followers(*own))
            out += [_stats(CONTEXTS, shard, [], f"{order - 1}-{shard}"), _below(own[0], shards)]
        if len(hot[1]):
            keys = _key(hot[0])
            by_key = np.argsort(keys)
            _save(f"{path}/{order}-{shard}", **_parted(keys[by_key]), counts=_narrow(hot[1][by_key]))
            contexts, stats = _gathered(*hot)
            out += [_stats(CONTEXTS, shard, [], f"{order}-{shard}"), _below(hot[0], shards), _pieces(CONTEXTS + order - 1, contexts, stats, _shard(_key(contexts), shards))]
        return pd.concat(out)

    return pieces.groupBy("shard").applyInPandas(run, PIECES)


def _merge_level(pieces: DataFrame, path: str, shards: int, m: int, order: int, files: frozenset[str]) -> DataFrame:
    """Writes n-grams of order m < order: counts beside the contexts that _merge_top wrote, and arrays of their own
    (a name with an x) for all others; what is meant for lower orders passes through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        mine = pdf["kind"].isin((COUNTS + m, CONTEXTS + m))
        columns, c = _joined(pdf[pdf["kind"] == COUNTS + m], m)
        contexts, stats = _joined(pdf[pdf["kind"] == CONTEXTS + m], m, 4)
        keys, context_keys = _key(columns), _key(contexts)
        out, left, name = [pdf[~mine]], np.ones(len(keys), dtype=bool), f"{m}-{shard}"
        if m == order - 1 and name in files:
            main = _load(f"{path}/{name}", "at", "high", "low")
            k = _find(main, keys)
            left = k < 0
            beside = np.zeros(len(main["high"]), dtype=np.int64)
            beside[k[~left]] = c[~left]
            _save(f"{path}/{name}", counts=_narrow(beside))
        own = np.unique(np.concatenate([keys[left], context_keys]))
        count, gathered = np.zeros(len(own), dtype=np.int64), np.zeros((len(own), 4), dtype=np.int64)
        count[np.searchsorted(own, keys[left])] = c[left]
        gathered[np.searchsorted(own, context_keys)] = stats
        if len(own):
            _save(f"{path}/{m}x-{shard}", **_parted(own), counts=_narrow(count), **_coded(gathered))
        numbers = _number_of(c) if m > 1 else [c.sum(), *_number_of(c), (c >= 3).sum()]
        out.append(_stats(m, shard, numbers, f"{m}x-{shard}" if len(own) else ""))
        if m > 1 and len(c):
            above, seen = _gathered(columns, c)
            out += [_pieces(CONTEXTS + m - 1, above, seen, _shard(_key(above), shards)), _below(columns, shards)]
        return pd.concat(out)

    return pieces.groupBy("shard").applyInPandas(run, PIECES)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen 1 to 4 times; where a small corpus
    gives none, plain values that leave a positive rest."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def train(docs: DataFrame, text_col: str = "text", shards: int | None = None, order: int = 2, frequent: int = FREQUENT) -> Model:
    """Counts the texts of docs (null: empty) and writes the model into the shared folder.

    Every n-gram of up to `order` words counts, with no cut-off; an end of a text is a word. Every row is a text,
    so repeated rows count as often as they occur; ids are not looked at. Of long texts every word counts. Unless
    given, shards follow from the counted bytes and tokens, and are as many as shuffle partitions at least. With no
    documents at all every probability is that of a uniform choice.

    Contexts whose words are all seen more than `frequent` times are spread over shards, so no shard holds more than
    so many followers of one context. At most 2 ** 32 - 2 different words can be told apart; more are refused.
    """
    if order < 2:
        raise ValueError(f"order is {order}; it must be 2 at least")
    spark = session(docs.sparkSession)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _folder(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards = shards or max(least, -(-size // SHARD_BYTES))
    files: set[str] = set()

    def taken(df: DataFrame) -> dict[int, dict[int, np.ndarray]]:
        """Statistics by kind and shard; a few numbers for each shard."""
        out: dict[int, dict[int, np.ndarray]] = {}
        for r in df.where("kind < 0").select("kind", "shard", "n", "data").toLocalIterator():
            out.setdefault(-1 - r["kind"], {})[r["shard"]] = np.frombuffer(r["data"][: 8 * r["n"]], dtype=np.int64)
            if name := bytes(r["data"][8 * r["n"] :]).decode():
                files.add(name)
        return out

    def total(found: dict[int, dict[int, np.ndarray]], kind: int, n: int) -> np.ndarray:
        return sum(found.get(kind, {}).values(), np.zeros(n, dtype=np.int64))

    of_words = taken(cut(_count_words(texts, path, word_shards))).get(WORDS, {})
    tokens, vocabulary = (int(sum(x[k] for x in of_words.values())) for k in (0, 1))
    if vocabulary >= UNKNOWN - 1:
        raise ValueError(f"{vocabulary} different words are too many")
    release(spark)
    n = shards or max(least, -(-tokens // SHARD_TOKENS))
    known = Model(path, word_shards, n, tokens, vocabulary, _numbered({k: x[2:] for k, x in of_words.items()}, word_shards), frozenset(files), frequent)
    merged = cut(_merge_top(_count_grams(texts, known, order), path, n, order))
    found = taken(merged)
    number = {order: total(found, order, 4)}
    for m in range(order - 1, 0, -1):
        release(spark)
        merged = cut(_merge_level(merged.where("kind > 0"), path, n, m, order, frozenset(files)))
        number[m] = total(taken(merged), m, 6 if m == 1 else 4)
    release(spark)
    low = number[1]
    return Model(
        path, word_shards, n, tokens, vocabulary, known.first, frozenset(files), frequent, tuple(_discounts(number[m]) for m in range(2, order + 1)),
        _discounts(low[1:5]), int(low[0]), (int(low[1]), int(low[2]), int(low[5])),
    )


# --- scoring ----------------------------------------------------------------------------------------------


def _load(base: str, *names: str) -> dict[str, np.ndarray]:
    return {n: np.asarray(np.load(f"{base}.{n}.npy", mmap_mode="r")) for n in names}


class Lookup:
    """The arrays of a model, mapped into memory on first use. Arrays that were written and are missing raise."""

    def __init__(self, m: Model):
        self.m = m
        self.first = np.array(m.first, dtype=np.int64).reshape(-1, CLASSES)
        self.open: dict[str, dict[str, np.ndarray] | None] = {}
        self.shares: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _arrays(self, name: str, *columns: str) -> dict[str, np.ndarray] | None:
        if name not in self.open:
            self.open[name] = _load(f"{self.m.path}/{name}", "at", "high", "low", *columns) if name in self.m.files else None
        return self.open[name]

    @staticmethod
    def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")
        ids, at = np.unique(shard[order], return_index=True)
        return zip(map(int, ids), np.split(order, at[1:]) if len(ids) else [], strict=True)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and training counts of the distinct words, in the order of their numbers, and for every word its
        place among them; UNKNOWN and 0, at the end, where training has not seen them."""
        distinct, _, back = _groups(hashes)
        ids, counts = np.full(len(distinct), UNKNOWN, dtype=np.uint32), np.zeros(len(distinct), dtype=np.int64)
        for s, rows in self._by_shard(_shard(distinct, self.m.word_shards)):
            if a := self._arrays(f"w-{s}", "counts", "place"):
                k = _find(a, distinct[rows])
                rows, k = rows[k >= 0], k[k >= 0]
                counts[rows] = a["counts"][k]
                ids[rows] = self.first[s, _classes(counts[rows])] + a["place"][k]
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.uint32)
        place[order] = np.arange(len(ids), dtype=np.uint32)
        return ids[order], counts[order], place[back]

    def _contexts(self, name: str, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By code: how often contexts of m words occur, how many words follow them, and the share that all of these
        give up for lower orders."""
        if name not in self.shares:
            total, kinds = self.open[name]["table"][:, 0], self.open[name]["table"][:, 1:]
            self.shares[name] = total, kinds.sum(axis=1), kinds @ np.array(self.m.discounts[m - 1]) / np.maximum(total, 1)
        return self.shares[name]

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Of n-grams, 0 where training has not seen them: counts; as contexts, how often they occur, how many words
        follow, the share for lower orders, and the shard and place where the words that follow begin (-1: nowhere, or
        they are spread)."""
        m = len(columns)
        distinct, _, back = _groups(_key(columns))
        counts, total, n, begin = (np.zeros(len(distinct), dtype=np.int64) for _ in range(4))
        share, begin[:] = np.zeros(len(distinct)), -1
        shard = _shard(distinct, self.m.shards)
        for s, rows in self._by_shard(shard):
            for name, above in ((f"{m}-{s}", ("base", "first", "word_high", "word_low", "times")), (f"{m}x-{s}", ())):
                if len(rows) and (a := self._arrays(name, "counts", "code", "table", *above)):
                    k = _find(a, distinct[rows])
                    hit, k, rows = rows[k >= 0], k[k >= 0], rows[k < 0]
                    counts[hit], code = a["counts"][k], a["code"][k]
                    for out, x in zip((total, n, share), self._contexts(name, m), strict=True):
                        out[hit] = x[code]
                    if above:
                        begin[hit] = a["base"][(distinct[hit] >> U64(48)).astype(np.int64)].astype(np.int64) + a["first"][k]
        return tuple(x[back] for x in (counts, total, n, share, shard, begin))

    def following(self, shard: np.ndarray, begin: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of n-grams of the highest order: of a word among the n that follow a context, by bisection."""
        out = np.zeros(len(word), dtype=np.int64)
        for s, rows in self._by_shard(shard):
            a = self.open[f"{self.m.order - 1}-{s}"]
            high, low, want, end = a["word_high"], a["word_low"], word[rows], begin[rows] + n[rows]
            of = lambda k: high[k].astype(np.uint32) << np.uint32(16) | low[k]  # noqa: B023, E731
            before = begin[rows] - 1  # the last place known to hold less
            for bit in reversed(range(int(n[rows].max()).bit_length())):
                some = np.flatnonzero(n[rows] >= 1 << bit)
                k = before[some] + (1 << bit)
                less = (k < end[some]) & (of(np.minimum(k, len(high) - 1)) < want[some])
                before[some] += less.astype(np.int64) << bit
            k = np.minimum(before + 1, len(high) - 1)
            out[rows] = np.where((before + 1 < end) & (of(k) == want), a["times"][k], 0)
        return out

    def spread(self, columns: list[np.ndarray]) -> np.ndarray:
        """Counts of n-grams of the highest order whose contexts are spread."""
        distinct, _, back = _groups(_key(columns))
        out = np.zeros(len(distinct), dtype=np.int64)
        for s, rows in self._by_shard(_shard(distinct, self.m.shards)):
            if a := self._arrays(f"{self.m.order}-{s}", "counts"):
                k = _find(a, distinct[rows])
                out[rows[k >= 0]] = a["counts"][k[k >= 0]]
        return out[back]

    def logs(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of texts: log10 probabilities, base log10 probabilities, training counts."""
        m = self.m
        known, times, rank = self.words(np.concatenate(held))
        word = times[rank]
        base = np.log10((times + 0.1) / (m.train_tokens + 0.1 * (m.vocabulary + 1)))[rank]
        place, left = _padded(held, rank, len(known))  # a begin stands after all words
        known, times = np.append(known, np.uint32(m.vocabulary)), np.append(np.minimum(times, UNKNOWN), UNKNOWN).astype(np.uint32)
        p, seen = known[place], times[place]
        token = np.concatenate([[False], left[1:] < left[:-1]])  # all places but the begins
        d = np.array([0.0, *m.low_discounts])
        counts, *above = (x[place] for x in self.grams([known]))  # of the words that end at each place
        uniform = 1.0 / (m.vocabulary + 1)
        if m.low_total:
            prob = (counts - d[np.minimum(counts, 3)]) / m.low_total + np.dot(m.low_discounts, m.low_kinds) / m.low_total * uniform
        else:
            prob = np.full(len(p), uniform)
        for k in range(2, m.order + 1):
            d = np.array([0.0, *m.discounts[k - 2]])
            rows = np.flatnonzero(left >= k)  # where n-grams begin; they end k - 1 places on
            at = rows + k - 1
            total, n, share, shard, begin = (x[at - 1] for x in above)
            if k < m.order:
                both, *found = self.grams([p[rows + j] for j in range(k)])
            else:
                both = np.zeros(len(rows), dtype=np.int64)
                here = np.flatnonzero(begin >= 0)
                both[here] = self.following(shard[here], begin[here], n[here], p[at[here]])
                hot = np.flatnonzero((begin < 0) & (total > 0) & _spread(seen, rows, k - 1, m.frequent))
                both[hot] = self.spread([p[rows[hot] + j] for j in range(k)])
            high = (both - d[np.minimum(both, 3)]) / np.maximum(total, 1) + share * prob[at]
            prob[at] = np.where(total > 0, high, prob[at])
            if k < m.order:
                for x, y in zip(above, found, strict=True):
                    x[:] = 0
                    x[at] = y
                above[-1][np.delete(np.arange(len(p)), at)] = -1
        return np.log10(prob[token]), base, word


@lru_cache(maxsize=2)
def _lookup(m: Model) -> Lookup:
    return Lookup(m)


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score) for whole texts, in one pass without a shuffle.

    A null or empty text is its end alone. Null ids and repeated rows come back as often as they occur, other
    columns are ignored, and of an empty table there are no rows."""
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _lookup(m)

        def flush() -> pa.RecordBatch:
            at = np.cumsum([0, *(len(x) for x in held[:-1])])
            log, base, word = look.logs(held)
            return batch_of(
                schema,
                {
                    "doc_id": pa.concat_arrays(ids), "n_tokens": [len(x) for x in held],
                    "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
                    "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(log, at),
                },
            )

        held, ids, size = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            new = _hashes(b.column("text").to_pylist())
            held += new
            ids.append(b.column("doc_id"))
            size += sum(map(len, new))
            if size >= AT_ONCE:
                yield flush()
                held, ids, size = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def with_perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return bucket_of(doc_id, folds) == 0


def op8(spark: SparkSession, sf_dir: str, order: int = 3) -> DataFrame:
    """Scores of all documents under a model of those whose crc32 modulo 10 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = train(docs.where(~held_out(F.col("doc_id"))), order=order)
    out = score(docs, m).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(m.train_tokens).cast("long"))
    return with_perplexity(out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
