"""Vocabularies, tf-idf, Huffman codes and byte-pair merges over corpora of any size."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.joins import join_single

BOL, EOL, UNK = "<bol>", "<eol>", "<unk>"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line of a document."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """A row (id, token) for each token of a document."""
    return docs.select(F.col(id_col), F.explode(T.tokenize_words(F.col(text_col), stop=None) if tokens is None else tokens).alias("token"))


@dataclass
class Vocabulary:
    """tokens: a table (token, count, idx); ids follow the alphabet."""

    tokens: DataFrame

    @classmethod
    def fit(cls, rows: DataFrame, min_count: int | None = None, max_tokens: int | None = None, n_lines: DataFrame | None = None) -> Vocabulary:
        """Counts a table with a column token. Tokens seen fewer than min_count times become <unk>; of the
        others the max_tokens commonest stay (ties by the alphabet). n_lines: a one-row table (n) that sets
        the counts of <bol> and <eol>."""
        counts = rows.groupBy("token").agg(F.count("*").alias("count"))
        if min_count is not None:
            name = F.when(F.col("count") < min_count, UNK).otherwise(F.col("token"))
            counts = counts.groupBy(name.alias("token")).agg(F.sum("count").alias("count"))
        if max_tokens is not None:
            kept = counts.where(F.col("token") != UNK).orderBy(F.desc("count"), "token").limit(max_tokens)
            rest = counts.join(kept.select("token"), "token", "left_anti").select(F.lit(UNK).alias("token"), "count")
            counts = kept.unionByName(rest).groupBy("token").agg(F.sum("count").alias("count"))
        if n_lines is not None:
            ends = n_lines.select(F.explode(F.array(F.lit(BOL), F.lit(EOL))).alias("token"), F.col("n").alias("count"))
            counts = counts.unionByName(ends)
        return cls(_ranked(counts))

    def most_common(self, n: int = 5) -> DataFrame:
        return self.tokens.orderBy(F.desc("count"), "token").limit(n)

    def words_with_count(self, k: int) -> DataFrame:
        return self.tokens.where(F.col("count") == k)

    def filter(self, rows: DataFrame, unk: bool = True) -> DataFrame:
        """Rows with a column token: unknown tokens become <unk>, or are dropped."""
        known = self.tokens.select("token", F.lit(True).alias("_known"))
        if not unk:
            return rows.join(known, "token", "left_semi")
        found = rows.join(known, "token", "left")
        return found.withColumn("token", F.when(F.col("_known"), F.col("token")).otherwise(UNK)).drop("_known")

    def words_to_indices(self, rows: DataFrame) -> DataFrame:
        """Adds idx to rows with a column token; unknown ones get the id of <unk>, or null without one."""
        unk = self.tokens.where(F.col("token") == UNK).agg(F.max("idx").alias("_unk"))
        found = rows.join(self.tokens.select("token", "idx"), "token", "left").crossJoin(F.broadcast(unk))
        return found.withColumn("idx", F.coalesce("idx", "_unk")).drop("_unk")

    def indices_to_words(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.tokens.select("idx", "token"), "idx", "left")


def _ranked(counts: DataFrame, parts: int = 64) -> DataFrame:
    """Adds idx, the place of each token in the alphabet, from 0. Ranks are counted within ranges of tokens
    and shifted by the sizes of the ranges before, so no task sorts the whole vocabulary."""
    key = F.substring("token", 1, 2)
    inner = counts.withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("token")) - 1)
    sizes = counts.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    before = sizes.select("_k", (F.sum("_n").over(W.orderBy("_k")) - F.col("_n")).alias("_before"))  # one row per two characters
    return inner.join(before, "_k").select("token", "count", (F.col("_r") + F.col("_before")).cast("bigint").alias("idx"))


def tfidf(rows: DataFrame, n_docs: DataFrame, smooth: bool = True, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, token, tf, tfidf) with idf = ln((D + s) / (df + s)) + 1 of a table (id, token). n_docs: a
    one-row table (n) with D. Tokens that very many documents have are spread over tasks by adaptive execution."""
    tf = rows.groupBy(id_col, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    s = 1 if smooth else 0
    idf = F.log((F.col("n") + s) / (F.col("df") + s)) + 1
    return join_single(tf, df, "token").crossJoin(F.broadcast(n_docs)).select(id_col, "token", "tf", (F.col("tf") * idf).alias("tfidf"))


def huffman_codes(counts: list[tuple[str, int]]) -> dict[str, str]:
    """Prefix codes of symbols by their counts; ties by the symbol, so codes are reproducible. One symbol
    alone gets the code 0."""
    order = count()
    heap = [(n, next(order), ((s, ""),)) for s, n in sorted(counts)]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {heap[0][2][0][0]: "0"}
    while len(heap) > 1:
        n0, _, a = heapq.heappop(heap)
        n1, _, b = heapq.heappop(heap)
        heapq.heappush(heap, (n0 + n1, next(order), tuple((s, "0" + c) for s, c in a) + tuple((s, "1" + c) for s, c in b)))
    return dict(heap[0][2]) if heap else {}


@dataclass
class HuffmanEncoder:
    """codes: a table (token, code)."""

    codes: DataFrame

    @classmethod
    def fit(cls, rows: DataFrame, most: int = 100_000) -> HuffmanEncoder:
        """Counts tokens in Spark and builds the tree from the counts on the driver; an alphabet of more than
        `most` symbols is refused rather than collected."""
        counts = rows.groupBy("token").agg(F.count("*").alias("n")).limit(most + 1).collect()
        if len(counts) > most:
            raise ValueError(f"more than {most} symbols")
        codes = huffman_codes([(r["token"], r["n"]) for r in counts])
        return cls(rows.sparkSession.createDataFrame(list(codes.items()), "token string, code string"))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds code; an unknown token raises."""
        found = rows.join(F.broadcast(self.codes), "token", "left")
        return found.withColumn("code", F.coalesce("code", F.raise_error(F.concat(F.lit("no code for "), "token")).cast("string")))

    def inverse_transform(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.codes), "code", "left")


def pair_counts(words: DataFrame) -> DataFrame:
    """Counts (pair, n) of adjacent symbols in words (symbols, n)."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.concat_ws(" ", F.slice("symbols", i, 2)))
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class BytePairEncoder:
    """merges: pairs of symbols in the order in which they were learned; symbols are byte values joined by _."""

    merges: list[tuple[str, str]]

    @classmethod
    def fit(cls, lines_: DataFrame, max_merges: int = 100, every: int = 20) -> BytePairEncoder:
        """Merges the commonest adjacent pair of bytes (ties by the pair), max_merges times at most, over
        distinct lines (line) with their counts. One pair per round reaches the driver; lineage is cut every
        few rounds."""
        symbols = T.utf8_bytes(F.col("line")).cast("array<string>")
        words = lines_.groupBy("line").agg(F.count("*").alias("n")).select(symbols.alias("symbols"), "n")
        words, merges = words.checkpoint(), []
        for k in range(max_merges):
            best = pair_counts(words).orderBy(F.desc("n"), "pair").first()
            if best is None or best["n"] < 2:
                break
            a, b = best["pair"].split(" ")
            merges.append((a, b))
            joined = F.regexp_replace(F.array_join("symbols", " "), rf"(?<!\S){a} {b}(?!\S)", f"{a}_{b}")
            words = words.select(F.split(joined, " ").alias("symbols"), "n")
            if (k + 1) % every == 0:
                words = words.checkpoint()
        return cls(merges)

    def transform(self, text: Column) -> Column:
        """Symbols of a text: merges applied in the order in which they were learned."""
        out = F.array_join(T.utf8_bytes(text).cast("array<string>"), " ")
        for a, b in self.merges:
            out = F.regexp_replace(out, rf"(?<!\S){a} {b}(?!\S)", f"{a}_{b}")
        return F.filter(F.split(out, " "), lambda s: s != "")

    def inverse_transform(self, symbols: Column) -> Column:
        numbers = F.filter(F.split(F.array_join(symbols, "_"), "_"), lambda s: s != "")
        return T.bytes_to_chars(F.transform(numbers, lambda s: s.cast("int")))
