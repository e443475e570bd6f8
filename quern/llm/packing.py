"""Packing of tokenized documents into sequences of a fixed capacity, best fit with large items matched.

Sizes are whole numbers of tokens up to the capacity, so a histogram of them (at most `capacity` rows, for
any corpus) is all that planning needs. The plan says how many sequences take which sizes; documents then
find their places by their rank among those of their size.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import cut, session, table

CAPACITY = 1024
END_ID = 2


# --- tokens ---------------------------------------------------------------------------------------------


def _class(kinds: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] in kinds)


_SPACE = r"\t-\r \x85\xa0"
_L, _N = _class("L"), _class("N")
#: The byte-level pre-tokenizer's pattern, for texts of the characters below U+0250 and a few signs.
_PIECES = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACE}{_L}{_N}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_OTHER = re.compile("[^\x00-ɏ–—‘’“”•…€]")


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level BPE writes for each byte: printable ones stand for themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer encodes each pre-token by itself, so ids of pre-tokens are remembered: up to `most` new ones
    and as many older ones. Texts with other characters, or with a special token's string, go to the
    tokenizer whole.
    """

    most = 100_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = _byte_signs()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            ids = [t.id for t in self.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.signs))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHER.search(text) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where
    longer than capacity; of several pieces the first takes the remainder. A null text is an empty one."""
    end = struct.pack("<I", end_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
            rows = b.column("doc_id").take(pa.array(at, type=pa.int64()))
            yield batch_of(schema, {"doc_id": rows, "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


# --- the plan -------------------------------------------------------------------------------------------


@dataclass
class Group:
    """Sequences that are filled alike: how many, the room left in each, and (size, times) of each."""

    bins: int
    gap: int
    items: tuple[tuple[int, int], ...] = field(default=())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Fills sequences with counts[size] items of each size.

    Items above a third of the capacity go at most two to a sequence: from the largest down, each takes the
    largest other one that fits beside it. Smaller items then go, from the largest down, where the least room
    remains that holds them; a new sequence opens when none does. All items of a size are placed at once, so
    the work depends on the capacity, not on the number of items.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    if left and not (0 < min(left) and max(left) <= capacity):
        raise ValueError("sizes must lie between 1 and the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    groups: dict[int, list[Group]] = defaultdict(list)
    gaps: list[int] = []

    def put(g: Group) -> None:
        if g.bins:
            if g.gap not in groups:
                insort(gaps, g.gap)
            groups[g.gap].append(g)

    while large:
        s = large[-1]
        k = bisect_left(large, capacity - s + 1) - 1
        if k < 0 or (large[k] == s and left[s] == 1 and k == 0):
            put(Group(left[s], capacity - s, ((s, 1),)))
            left[s] = 0
        else:
            t = large[k]
            if t == s and left[s] == 1:
                t = large[k - 1]
            if t == s:
                n = left[s] // 2
                put(Group(n, capacity - 2 * s, ((s, 2),)))
                left[s] -= 2 * n
            else:
                n = min(left[s], left[t])
                put(Group(n, capacity - s - t, ((s, 1), (t, 1))))
                left[s] -= n
                left[t] -= n
                if not left[t]:
                    large.remove(t)
        if not left[s]:
            large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        c = left[s]
        while c:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                put(Group(-(-c // (capacity // s)), capacity))
                continue
            gap = gaps[k]
            g = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            each = gap // s
            full, rest = divmod(c, each)
            if full >= g.bins:
                full, rest = g.bins, 0
            put(Group(full, gap - each * s, (*g.items, (s, each))))
            if rest:
                put(Group(1, gap - rest * s, (*g.items, (s, rest))))
            put(Group(g.bins - full - bool(rest), gap, g.items))
            c -= full * each + rest
    return [g for gap in sorted(groups) for g in groups[gap] if g.items]


def slots(groups: list[Group]) -> pd.DataFrame:
    """For each size, ranges of ranks (from r0 on) and where they go: sequence base + (rank - r0) // times,
    offset first + (rank - r0) % times * size."""
    rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for g in groups:
        offset = 0
        for size, times in g.items:
            rows.append((size, rank[size], base, times, offset))
            rank[size] += g.bins * times
            offset += size * times
        base += g.bins
    return pd.DataFrame(rows, columns=["size", "r0", "base", "times", "first"]).sort_values(["size", "r0"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Only the histogram of lengths reaches the driver. The rank within a length is counted in salted parts, so
    a length that very many pieces share is spread over tasks. Order of ties does not matter: any piece may
    stand for another of its length.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(plan(counts, capacity))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(64, sum(counts.values()) // parts)
    salts = max(1, -(-max(counts.values(), default=1) // most))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    size, r0, base, times, first = (where[c].to_numpy(dtype=np.int64) for c in ("size", "r0", "base", "times", "first"))
    columns = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = size * (1 << 48) + r0  # ranks stay far below 2**48
        for b in batches:
            length, rank = (np.array(b.column(c), dtype=np.int64) for c in ("length", "rank"))
            k = np.searchsorted(edge, length * (1 << 48) + rank, side="right") - 1
            d = rank - r0[k]
            arrays = [b.column(c) for c in columns] + [pa.array(base[k] + d // times[k]), pa.array(first[k] + d % times[k] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    session(spark)
    return pack(pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
