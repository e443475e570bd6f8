"""Near-duplicate documents by compressed MinHash registers (HyperMinHash).

Each distinct shingle of a document hashes into one bucket; a bucket keeps, of its smallest hash, the number
of leading zeros and a few mantissa bits. Buckets that got nothing borrow from the first filled one in a
fixed order of their own, so that registers of two sets still agree with the probability of their Jaccard
similarity. Runs of registers form band keys; documents that share one are candidates. A candidate pair is
dropped when its Jaccard estimate, corrected for chance agreement of registers, is far below the threshold,
and the others are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import U64, cut, hash_words, mix, odd_constants, release, session, table, text_key, with_class, word_hashes
from quern.llm.components import connected_components

MANTISSA = 10


@dataclass(frozen=True)
class Scheme:
    """words: shingle length. percent: links need 100 * intersection >= percent * union. bands x rows
    registers are kept; at 36 x 7 a pair with a similarity of 0.85 is missed with a probability of 1e-6.
    slack: standard errors below the threshold down to which an estimate is still confirmed exactly."""

    words: int = 5
    percent: int = 85
    bands: int = 36
    rows: int = 7
    slack: float = 5.0
    block: int = 256
    few: int = 16

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - self.slack * (t * (1 - t) / self.registers) ** 0.5


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; with fewer words, one for them all."""
    return shingled(word_hashes(text), n)


def shingled(h: np.ndarray, n: int) -> np.ndarray:
    """shingles() of the hashes of a text's words."""
    if not len(h):
        return h
    c = odd_constants(n, 11)
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, dtype=U64)
    for i in range(k):
        out += h[i : i + len(out)] * c[i]
    return np.unique(mix(out + U64(k)))


@lru_cache(maxsize=4)
def _probes(n: int) -> np.ndarray:
    """For each register, the order in which it looks for a filled one."""
    rng = np.random.default_rng(29)
    return np.stack([rng.permutation(n) for _ in range(n)]).astype(np.int32)


def registers(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Compressed registers of hash sets, one row of n uint16 for each; all 0 for an empty set."""
    least = np.full((len(sets), n), 2**32, dtype=np.int64)
    for row, s in zip(least, sets, strict=True):
        if len(s):
            np.minimum.at(row, ((s >> U64(32)) * U64(n) >> U64(32)).astype(np.int64), (s & U64(0xFFFFFFFF)).astype(np.int64))
    filled = least < 2**32
    length = np.frexp(least.astype(np.float64))[1]  # bits in use; exact for integers below 2**53
    zeros = np.where(filled, 32 - length, 0)
    rest = np.where(length > 0, least - (np.int64(1) << np.maximum(length - 1, 0)), 0)
    shift = length - 1 - MANTISSA
    head = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0))
    out = np.where(filled, ((zeros + 1) << MANTISSA) | (head & (2**MANTISSA - 1)), 0).astype(np.uint16)
    some = filled.any(axis=1)
    i, j = np.nonzero(~filled & some[:, None])
    probes, src = _probes(n), out.copy()
    for k in range(n):
        if not len(i):
            break
        got = src[i, probes[j, k]]
        hit = got > 0
        out[i[hit], j[hit]] = got[hit]
        i, j = i[~hit], j[~hit]
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 key for each band of each row of registers."""
    c = odd_constants(bands * rows, 17).reshape(bands, rows)
    x = regs.reshape(len(regs), bands, rows).astype(U64)
    return mix((x * c).sum(axis=2, dtype=U64) + (np.arange(bands, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows. Two different minima get the same register by chance when they
    have as many leading zeros (1/3 of the time) and equal mantissas; that share is taken out."""
    chance = 2.0**-MANTISSA / 3
    return np.maximum(0.0, ((x == y).mean(axis=-1) - chance) / (1 - chance))


def sketch(docs: DataFrame, id_col: str, text_col: str, s: Scheme) -> DataFrame:
    """Rows (row, id, tk, n, fp1, fp2, sig): a number of the row's own, a hash of the text, the size of the
    shingle set, a 128-bit fingerprint of the set, and its registers. One pass over the texts, without a shuffle."""

    schema = "row long, id long, tk long, n long, fp1 long, fp2 long, sig binary"
    total = lambda xs: np.array([x.sum(dtype=U64) for x in xs], dtype=U64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for b in batches:
            sets = [shingled(h, s.words) for h in hash_words(b.column("text").to_pylist())]
            yield batch_of(
                schema,
                {
                    "row": np.arange(first, first + len(sets), dtype=np.int64), "id": b.column("id"), "tk": b.column("tk"), "n": [len(x) for x in sets],
                    "fp1": total(mix(x ^ U64(0xA5A5)) for x in sets), "fp2": total(mix(x + U64(0x5BD1E995)) for x in sets),
                    "sig": [r.tobytes() for r in registers(sets, s.registers)],
                },
            )
            first += len(sets)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).cast("string").alias("text"))


def _bands(reps: DataFrame, s: Scheme) -> DataFrame:
    schema = "key long, rep long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint16).reshape(b.num_rows, s.registers)
                yield batch_of(schema, {"key": band_keys(regs, s.bands, s.rows).ravel(), "rep": np.repeat(b.column("rep").to_numpy(), s.bands)})

    return reps.select("rep", "sig").mapInArrow(run, schema)


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _estimated(pairs: DataFrame, reps: DataFrame, s: Scheme) -> DataFrame:
    """Of pairs (a, b), those whose sizes and estimates allow a link: (a, b, est)."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").where(_sizes_fit(F.col("n_a"), F.col("n_b"), s.percent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint16).reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
                pdf = pdf[["a", "b"]].assign(est=estimate(x, y))
                yield pdf[pdf["est"] >= s.least_estimate]

    return joined.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long, est double")


class _Sources:
    """Texts of classes, read again from the documents: a class is found by the id and text key of one of its rows.

    many: rows of a table of wanted texts up to which it is broadcast (it is counted first); beyond that the
    texts are shuffled.
    """

    def __init__(self, texts: DataFrame, reps: DataFrame, many: int = 500_000):
        self.texts, self.many = texts, many
        self.keys = reps.select("rep", "id", "tk", "again")

    def of(self, wanted: DataFrame, rep: str, name: str) -> DataFrame:
        """wanted, whose column rep holds classes, with their texts in the column name."""
        columns = wanted.columns
        keys = self.keys.select(F.col("rep").alias(rep), F.col("id").alias("_id"), F.col("tk").alias("_tk"), "again")
        wanted = cut(wanted.join(keys, rep))
        few = wanted.agg(F.count("*"), F.sum(F.col("again").cast("long"))).first()
        found = lambda w: self.texts.join(F.broadcast(w) if few[0] <= self.many else w, (F.col("tk") == F.col("_tk")) & F.col("id").eqNullSafe(F.col("_id"))).select(*columns, F.col("text").alias(name))
        if not few[1]:
            return found(wanted)
        # rows that repeat both id and text stand for one text
        return found(wanted.where("not again")).unionByName(found(wanted.where("again")).dropDuplicates(columns))


def _confirmed(pairs: DataFrame, sources: _Sources, s: Scheme) -> DataFrame:
    """Of distinct pairs (a, b), those whose full shingle sets meet the threshold."""
    other = sources.of(pairs.select("a").distinct(), "a", "t_a")
    joined = sources.of(pairs.select("a", "b"), "b", "t_b").join(other, "a").sortWithinPartitions("a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, None
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for k, (a, ta, tb) in enumerate(zip(pdf["a"], pdf["t_a"], pdf["t_b"], strict=True)):
                if a != last:
                    last, x = a, shingles(ta, s.words)
                y = shingles(tb, s.words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= s.percent * (len(x) + len(y) - both)
            yield pdf.loc[keep, ["a", "b"]]

    return joined.select("a", "b", "t_a", "t_b").mapInPandas(run, "a long, b long")


def _labelled(df: DataFrame, labels: DataFrame, on: str, name: str) -> DataFrame:
    found = labels.select(F.col("id").alias(on), F.col("component_id").alias("_c"))
    return df.join(found, on, "left").withColumn(name, F.coalesce("_c", on)).drop("_c")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y, as products of 0/1 matrices of
    `width` shingles at a time."""
    h, row = np.concatenate([*x, *y]), np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    distinct, col, n = np.unique(h, return_inverse=True, return_counts=True)
    many = n[col] > 1  # what one set alone has counts for no pair
    number = np.cumsum(n > 1) - 1
    row, col = row[many], number[col[many]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(col, (start, start + width))
        m = np.zeros((len(x) + len(y), width), dtype=np.float32)
        m[row[lo:hi], col[lo:hi] - start] = 1
        out += (m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    return out


def _blocked(members: DataFrame, reps: DataFrame, sources: _Sources, s: Scheme) -> DataFrame:
    """Links within large buckets, (a, b), from members (key, rep, comp, c, most): most is the bucket's largest
    component, so all that is left to compare are members outside it with all members.

    Both sides are dealt into blocks, and a pair of blocks is one group, of 2 * block members or so whatever the
    size of the bucket. Groups first keep the members that some estimate allows to link with another component;
    only their texts are read, and a second pass confirms on full sets. What it emits is, for each member that
    it links, the smallest one reached there, so rows grow with members and not with pairs.
    """
    size = members.groupBy("key").agg(F.count_if(F.expr("comp <> most")).alias("outside"), F.count("*").alias("all"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / s.block)).cast("int")
    size = cut(size.select("key", blocks(F.col("outside")).alias("ni"), blocks(F.col("all")).alias("nj")))
    dealt = members.join(size, "key")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = dealt.where("comp <> most").select("key", "rep", "comp", F.lit(1).alias("side"), at("ni").alias("i"), every("nj").alias("j"))
    inner = dealt.select("key", "rep", "comp", F.lit(0).alias("side"), every("ni").alias("i"), at("nj").alias("j"))
    placed = outer.unionByName(inner).join(reps.select("rep", "n", "sig"), "rep")
    schema = "key long, i int, j int, side int, rep long, comp long, n long"

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), -1)
        rep, comp, n, side = (pdf[c].to_numpy() for c in ("rep", "comp", "n", "side"))
        x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        keep = np.zeros(len(pdf), dtype=bool)
        for at in x:
            ok = y[(comp[y] != comp[at]) & (np.minimum(n[y], n[at]) * 100 >= np.maximum(n[y], n[at]) * s.percent)]
            hit = ok[estimate(regs[ok], regs[at]) >= s.least_estimate] if len(ok) else ok
            keep[hit] = True
            keep[at] |= len(hit) > 0
        return pdf.loc[keep, ["key", "i", "j", "side", "rep", "comp", "n"]]

    groups = ["key", "i", "j"]
    left = cut(placed.select(*groups, "side", "rep", "comp", "n", "sig").groupBy(*groups).applyInPandas(likely, schema))
    texts = sources.of(left.select("rep").distinct(), "rep", "text")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, comp, n, side = (pdf[c].to_numpy() for c in ("rep", "comp", "n", "side"))
        x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        label = {}
        if len(x) and len(y):
            sets = [shingles(t, s.words) for t in pdf["text"]]
            both = _overlaps([sets[k] for k in x], [sets[k] for k in y])
            hit = (comp[x][:, None] != comp[y][None]) & (100 * both >= s.percent * (n[x][:, None] + n[y][None] - both))
            label = _reached(rep[x], rep[y], hit)
        return pd.DataFrame({"a": list(label.values()), "b": list(label)}, dtype="int64")

    return left.join(texts, "rep").groupBy(*groups).applyInPandas(linked, "a long, b long")


def _reached(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> dict[int, int]:
    """For each id with a hit, the smallest id that it reaches by hits between a's and b's ids."""
    top = np.iinfo(np.int64).max
    best = {int(v): int(v) for v in (*a[hit.any(axis=1)], *b[hit.any(axis=0)])}
    while best:
        la, lb = (np.array([best.get(int(v), v) for v in side], dtype=np.int64) for side in (a, b))
        new = dict(best)
        for side, other, m in ((a, lb, hit), (b, la, hit.T)):
            least = np.where(m, other[None], top).min(axis=1)
            for v, x in zip(side[m.any(axis=1)], least[m.any(axis=1)], strict=True):
                new[int(v)] = min(new[int(v)], int(x))
        if new == best:
            break
        best = new
    return {k: v for k, v in best.items() if k != v}


def _classes(sketches: DataFrame) -> DataFrame:
    """A row for each distinct shingle set: (fp1, fp2, c, least, rep, again): how many rows have it, the
    smallest id of them, one row that stands for it (one with an id if any has), and whether other rows repeat
    both that row's id and its text."""
    texts = sketches.groupBy("fp1", "fp2", "id", "tk").agg(F.count("*").alias("m"), F.min("row").alias("row"))
    one = F.min(F.struct(F.isnull("id").alias("no_id"), "row", (F.col("m") > 1).alias("again")))
    return texts.groupBy("fp1", "fp2").agg(F.sum("m").alias("c"), F.min("id").alias("least"), one.alias("one")).select("fp1", "fp2", "c", "least", "one.row", "one.again").withColumnRenamed("row", "rep")


def _candidates(reps: DataFrame, s: Scheme) -> DataFrame:
    """Rows (key, rep, c, lead): the band keys that several classes share, their sizes and smallest classes."""
    bands = _bands(reps, s)
    keys = cut(bands.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lead")).where("c > 1"))
    return cut(bands.join(keys, "key"))


def _links(reps: DataFrame, sources: _Sources, s: Scheme) -> DataFrame:
    """Edges (a, b) that connect all classes which links connect.

    A bucket is first compared with its smallest class alone, each class with the best estimated of its leads.
    Of buckets whose members are in several components after that, the pairs between components follow.
    """
    spark = reps.sparkSession
    shared = _candidates(reps, s)
    release(spark)
    pairs = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    first = cut(_estimated(pairs, reps, s))
    best = cut(first.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"))
    edges = cut(_confirmed(best, sources, s))
    release(spark)
    labels = connected_components(edges)

    open_ = cut(_labelled(shared.where("c > 2 and rep <> lead").select("key", "rep"), labels, "rep", "comp"))
    groups = (
        open_.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sum"))
        .where("lo <> hi")
        .groupBy("c", "sum")  # buckets with the same members count once
        .agg(F.min("key").alias("key"))
        .select("key", "c")
    )
    left = cut(open_.join(cut(groups), "key"))
    release(spark)
    few, many = left.where(F.col("c") <= s.few), left.where(F.col("c") > s.few)
    one, two = (few.select("key", F.col("rep").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    more = one.join(two, "key").where("a < b and comp_a <> comp_b").select("a", "b").distinct()
    rest = first.join(best, ["a", "b"], "left_anti").select("a", "b").unionByName(_estimated(more, reps, s).select("a", "b")).distinct()
    rest = _labelled(_labelled(rest, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")
    edges = edges.unionByName(cut(_confirmed(cut(rest), sources, s)))
    release(spark)
    largest = many.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    if not many.isEmpty():
        edges = edges.unionByName(cut(_blocked(cut(many.join(cut(largest), "key")), reps, sources, s)))
    release(spark)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = Scheme()) -> DataFrame:  # noqa: B008
    """Groups near-duplicate documents: rows (id, text_key, n_shingles, component_id, kept), one for each row.

    Every row is a document of its own, whatever its id. component_id is the smallest id that it reaches by
    links, its own included; kept marks rows that have this id themselves. So rows that repeat an id with
    different texts are compared and grouped each by its own text, and rows that repeat both are kept or not
    together. A row with a null id links like any other: its component_id is the smallest id reached, null if
    there is none, and it is not kept. Texts that are null, empty or white space have no shingles, link with
    nothing, and are their own component. text_key is a hash of the text. Other columns are ignored; of an empty
    table there are no rows.

    Equal sets are one class before any comparison, so exact copies are never paired, and no group of copies is
    expanded into all pairs; yet no candidate pair of different components goes uncompared.
    """
    spark = session(docs.sparkSession)
    sketches = cut(sketch(docs, id_col, text_col, scheme))
    release(spark)
    full = sketches.where("n > 0")
    classes = cut(_classes(full))
    reps = classes.select("rep", "again").join(full.select(F.col("row").alias("rep"), "id", "tk", "n", "sig"), "rep")
    reps = cut(reps)
    edges = _links(reps, _Sources(_texts(docs, id_col, text_col), reps), scheme)
    found = connected_components(edges).withColumnRenamed("id", "rep")
    # the smallest id of a component is that of all its classes
    least = cut(classes.select("rep", "least").join(found, "rep").groupBy("component_id").agg(F.min("least").alias("of_all")))
    named = classes.join(found.join(least, "component_id").select("rep", "of_all"), "rep", "left")
    named = named.select("fp1", "fp2", "c", F.coalesce("of_all", "least").alias("component_id"))
    columns = ["id", "tk", "n"]
    grouped = with_class(full.select(*columns, "fp1", "fp2"), named, ["fp1", "fp2"]).select(*columns, "component_id")
    out = grouped.unionByName(sketches.where("n = 0").select(*columns, F.col("id").alias("component_id")))
    return out.select("id", F.col("tk").alias("text_key"), F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 5-word shingles, similarity 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: op3 in DuckDB: all pairs that share a shingle, and what they reach. For small tables.
ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM words WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN size USING (doc_id)
"""
