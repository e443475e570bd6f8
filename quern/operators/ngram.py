"""N-gram language models as count tables: maximum likelihood, additive and Good-Turing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.vocabulary import BOL, EOL
from quern.operators.joins import join_single


def padded(words: Column, n: int) -> Column:
    """Words of a line with max(1, n - 1) begin and end marks."""
    p = max(1, n - 1)
    return F.concat(F.array_repeat(F.lit(BOL), p), words, F.array_repeat(F.lit(EOL), p))


def gram_counts(lines: DataFrame, n: int, line_col: str = "line") -> DataFrame:
    """Counts (gram, count) of n-grams of lines, padded; grams are words joined by spaces. A unigram count
    leaves the marks out."""
    words = lines.select(T.tokenize_words(F.col(line_col), stop=None).alias("w")).where(F.size("w") > 0)
    words = words.select((padded(F.col("w"), n) if n > 1 else F.col("w")).alias("w"))
    return gram_rows(words, n).groupBy("gram").agg(F.count("*").alias("count"))


def gram_rows(words: DataFrame, n: int, *keep: str) -> DataFrame:
    """A row (keep, gram) for each n-gram of arrays w. Positions are exploded and the words fetched by position,
    which stays in generated code."""
    at = words.where(F.size("w") >= n).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
    return at.select(*keep, F.concat_ws(" ", *(F.get("w", F.col("i") + k) for k in range(n))).alias("gram"))


def last(gram: Column) -> Column:
    return F.substring_index(gram, " ", -1)


def prefix(gram: Column) -> Column:
    """All words but the last; empty for one word."""
    return F.substring(gram, 1, F.length(gram) - F.length(last(gram)) - 1)


@dataclass
class NGram:
    """counts: (gram, count) of order n. Contexts are counted from the same table, so that a context's
    continuations sum to it and a line's first grams have one too."""

    n: int
    counts: DataFrame

    @classmethod
    def train(cls, lines: DataFrame, n: int) -> NGram:
        return cls(n, gram_counts(lines, n))

    def contexts(self) -> DataFrame:
        return self.counts.groupBy(prefix(F.col("gram")).alias("context")).agg(F.sum("count").alias("context_count"))

    def vocabulary(self) -> DataFrame:
        """One row (v): distinct words besides the marks, and one for unknown words."""
        words = self.counts.select(last(F.col("gram")).alias("w")).where(~F.col("w").isin(BOL, EOL))
        return words.agg((F.countDistinct("w") + 1).alias("v"))

    def scored(self, grams: DataFrame) -> DataFrame:
        """Adds count and context_count (0 where unseen) to rows with a column gram."""
        own = grams.join(self.counts, "gram", "left").withColumn("context", prefix(F.col("gram")))
        own = join_single(own, self.contexts(), "context", "left")
        return own.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count", "context_count")})

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """Adds log_prob."""
        raise NotImplementedError

    def log_prob(self, sentences: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """Rows (id, n_grams, log_prob, cross_entropy, perplexity) of texts with n words at least; a text with
        an impossible n-gram has a log probability of -infinity."""
        words = sentences.select(F.col(id_col).alias("id"), T.tokenize_words(F.col(text_col), stop=None).alias("w")).where(F.size("w") >= self.n)
        grams = gram_rows(words, self.n, "id")
        out = self.probabilities(grams).groupBy("id").agg(F.count("*").alias("n_grams"), F.sum("log_prob").alias("log_prob"))
        out = out.withColumn("cross_entropy", -F.col("log_prob") / F.col("n_grams"))
        return out.withColumn("perplexity", F.exp("cross_entropy"))

    def completions(self, context: str) -> DataFrame:
        """Rows (word, log_prob) for each word that followed the context."""
        own = self.counts.where(prefix(F.col("gram")) == context.lower()).select("gram")
        return self.probabilities(own).select(last(F.col("gram")).alias("word"), "log_prob")

    def generate(self, n_sentences: int = 5, seed: int = 0, most: int = 100) -> list[list[str]]:
        """Sentences sampled word by word until the end mark or `most` words."""
        spark = self.counts.sparkSession
        start = [BOL] * max(1, self.n - 1)
        told = spark.createDataFrame([(k, start) for k in range(n_sentences)], "k int, words array<string>")
        known = self.probabilities(self.counts.select("gram")).select(prefix(F.col("gram")).alias("context"), last(F.col("gram")).alias("word"), "log_prob").checkpoint()
        # all sentences take a word at once; of its context's words each draws the one with the earliest clock
        for at in range(len(start), most):
            open_ = told.where(F.element_at("words", -1) != EOL)
            if open_.isEmpty():
                break
            context = F.array_join(F.slice("words", F.size("words") - self.n + 2, self.n - 1), " ") if self.n > 1 else F.lit("")
            drawn = open_.withColumn("context", context).join(known, "context", "left")
            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(at), "k", "word"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
            best = drawn.groupBy("k", "words").agg(F.min_by("word", -F.log(u) / F.exp("log_prob")).alias("word"))
            grown = best.select("k", F.concat("words", F.array(F.coalesce("word", F.lit(EOL)))).alias("words"))
            told = told.where(F.element_at("words", -1) == EOL).unionByName(grown).checkpoint()
        return [[w for w in r["words"] if w not in (BOL, EOL)] for r in told.orderBy("k").collect()]


class MLENGram(NGram):
    def probabilities(self, grams: DataFrame) -> DataFrame:
        p = F.log(F.col("count") / F.col("context_count"))
        return self.scored(grams).withColumn("log_prob", F.when((F.col("count") > 0) & (F.col("context_count") > 0), p).otherwise(F.lit(-math.inf)))


@dataclass
class AdditiveNGram(NGram):
    k: float = 1.0

    def probabilities(self, grams: DataFrame) -> DataFrame:
        p = (F.col("count") + self.k) / (F.col("context_count") + F.col("v") * self.k)
        return self.scored(grams).crossJoin(F.broadcast(self.vocabulary())).withColumn("log_prob", F.log(p)).drop("v")


@dataclass
class GoodTuringNGram(NGram):
    """Simple Good-Turing: counts of counts, averaged over their neighbours and fitted by a line in logs; the
    empirical estimate serves until it first differs from the fitted one by less than conf standard errors."""

    conf: float = 1.96

    def smoothed(self) -> DataFrame:
        """Rows (r, nr, smoothed): a table with a row per distinct count."""
        coc = self.counts.groupBy(F.col("count").alias("r")).agg(F.count("*").alias("nr"))
        one = W.orderBy("r")  # as many rows as there are distinct counts
        before, after = F.coalesce(F.lag("r").over(one), F.lit(0)), F.lead("r").over(one)
        z = F.col("nr") / F.when(after.isNull(), F.col("r") - before).otherwise((after - before) / 2)
        coc = coc.withColumn("z", z).withColumn("next", F.when(after == F.col("r") + 1, F.lead("nr").over(one)))
        fit = coc.agg(F.regr_slope(F.log("z"), F.log("r")).alias("slope"), F.regr_intercept(F.log("z"), F.log("r")).alias("intercept"))
        n = lambda r: F.exp(F.col("intercept") + F.col("slope") * F.log(r))
        out = coc.crossJoin(F.broadcast(fit)).withColumn("line", (F.col("r") + 1) * n(F.col("r") + 1) / n(F.col("r")))
        raw = (F.col("r") + 1) * F.col("next") / F.col("nr")
        error = self.conf * F.sqrt((F.col("r") + 1) ** 2 * F.col("next") / F.col("nr") ** 2 * (1 + F.col("next") / F.col("nr")))
        switch = F.col("next").isNull() | (F.abs(raw - F.col("line")) <= error)
        out = out.withColumn("switched", F.max(switch).over(one.rowsBetween(W.unboundedPreceding, 0)))
        return out.select("r", "nr", F.when(F.col("switched"), F.col("line")).otherwise(raw).alias("smoothed"))

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """Smoothed joint probabilities; what unseen n-grams share is spread over all that are possible."""
        table = self.smoothed()
        total = table.agg(F.sum(F.col("r") * F.col("nr")).alias("total"), F.sum(F.col("smoothed") * F.col("nr")).alias("mass"), F.sum(F.when(F.col("r") == 1, F.col("nr"))).alias("n1"), F.sum("nr").alias("seen"))
        total = total.crossJoin(self.vocabulary())
        own = grams.join(self.counts, "gram", "left").join(F.broadcast(table.select(F.col("r").alias("count"), "smoothed")), "count", "left").crossJoin(F.broadcast(total))
        p0 = F.coalesce("n1", F.lit(0)) / F.col("total")
        p = F.when(F.col("smoothed").isNotNull(), (1 - p0) * F.col("smoothed") / F.col("mass")).otherwise(p0 / F.greatest(F.pow("v", F.lit(self.n)) - F.col("seen"), F.lit(1.0)))
        return own.withColumn("log_prob", F.log(p)).drop("smoothed", "total", "mass", "n1", "seen", "v")
