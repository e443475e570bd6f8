"""Shared helpers of the corpus operators: session set-up, word hashing, lineage cuts."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
U64 = np.uint64
#: Bytes of an Arrow batch to a Python worker, beyond its first row.
BATCH_BYTES = 8 << 20


def session(spark: SparkSession) -> SparkSession:
    """Prepares a session: Python workers find this package, Arrow batches are bounded in rows and bytes, and a
    checkpoint folder exists.

    The folder is the one that the cluster names in spark.checkpoint.dir. Where that is unset, a local session
    (driver and executors in one process) gets a temporary one, and any other raises: its executors would not
    share it.
    """
    sc = spark.sparkContext
    env = sc.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    # workers are reused from stage to stage, so what one of them holds on to adds up
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(1 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or session(spark).sparkContext.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage."""
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more. It does so when the
    driver's JVM finds their handles unreachable, which a driver with a large heap may not do for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """rows with the columns of their class, where classes has one row for each value of keys and a column c,
    the number of rows in it.

    Classes that hold over 1/most of all rows are fewer than `most`; these are broadcast, so that none of them
    sends its rows to one task. The others are joined by a shuffle.
    """
    classes = cut(classes)
    least = max(1000, (classes.agg(F.sum("c")).first()[0] or 0) // most)
    large = F.broadcast(classes.where(F.col("c") >= least).limit(most))
    small = classes.where(F.col("c") < least)
    hot = rows.join(large, keys)
    cold = rows.join(large.select(*keys), keys, "left_anti").join(small, keys)
    return hot.unionByName(cold)


def text_key(text: Column) -> Column:
    """A hash that tells texts apart; rows with equal ids and keys have equal decisions."""
    return F.xxhash64(text.cast("string"))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Bytes of texts that are hashed at once, and of a word up to which its hash is a polynomial of its bytes.
CHUNK, LONG_WORD = 1 << 19, 48
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=1)
def _polynomial() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    of_byte = np.random.default_rng(41).integers(0, 2**64, 256, dtype=U64)
    factors = [np.full(CHUNK + 1, b, dtype=U64) for b in (base, pow(base, -1, 2**64))]
    for f in factors:
        f[0] = 1
    return of_byte, *(np.cumprod(f, dtype=U64) for f in factors)


def _hashed_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of at most CHUNK bytes, and where they begin. A word's polynomial is a difference of the
    running sum, shifted back to its begin; words over LONG_WORD bytes, for which such sums are weak, are hashed whole."""
    of_byte, power, inverse = _polynomial()
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[a], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(of_byte[a] * power[: len(a)], dtype=U64)])
    h = mix((total[end] - total[first]) * inverse[first] + (end - first).astype(U64))
    for k in np.flatnonzero(end - first > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[first[k] : end[k]])
    return h, first


def hash_words(texts: Sequence[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words() of texts, in order, an array for each text."""
    out: list[np.ndarray] = []
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        h, first = _hashed_chunk(b"\n".join(held))
        begin = np.cumsum([0, *(len(x) + 1 for x in held)])
        out.extend(np.split(h, np.searchsorted(first, begin[1:-1])))
        held, size = [], 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if held and size + len(data) >= CHUNK:
            flush()
        if len(data) < CHUNK:
            held.append(data)
            size += len(data) + 1
        else:
            out.append(_hashed_long(data))
    if held:
        flush()
    return out


def _hashed_long(data: bytes) -> np.ndarray:
    """As of a text of any length, in pieces that end at white space; a word that fills a piece is hashed whole."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                rest = re.compile(rb"[\x20\x09-\x0D]").search(data, end)
                end = rest.start() if rest else len(data)
                parts.append(np.array([xxhash.xxh3_64_intdigest(data[at:end])], dtype=U64))
                at = end
                continue
        parts.append(_hashed_chunk(data[at:end])[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=U64)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, in order."""
    return hash_words([text])[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the one of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, size=n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, y) of at most n of labels (id, y): the first by a hash of their ids. They are chosen
    before texts are read, so what is broadcast has n rows at most and no text is shuffled."""
    chosen = labels.where("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(n)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(cut(chosen)), "id")
