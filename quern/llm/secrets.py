"""Secrets in texts, with DataFrame functions alone: fixed patterns, and strings that a character model holds
to be random.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are counted
from labelled samples and smoothed towards the characters' frequencies in both. A long token counts as a secret
where the log-likelihood ratio of the two is high enough, in all and for each character, and no fixed pattern
covers it. The model is a table of one number per pair of characters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import session, table

#: Fixed patterns: kind, expression, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run is found whole, so runs of 16 and more are the runs that are long enough
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Words of which labelled identifiers are made, beside those of documents. A parameter of labelled_samples().
IDENTIFIER_WORDS = (
    "get set is has add remove update create delete find load save read write open close start stop run init parse format build make "
    "http request response server client handler service factory manager provider controller adapter builder proxy wrapper context session "
    "user account customer order product item list map array string number value key name type index count size length offset buffer stream "
    "file path directory home config option setting parameter argument property attribute field column table row query result record entry "
    "abstract base default internal external public private static final test mock example sample project module package class object "
    "window button panel frame title color image font width height border layout event listener thread process task queue lock cache "
    "error exception message log debug info warning time date year month day java python script com org net www html json xml url"
).split()
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class Settings:
    """documents: documents whose words make labelled identifiers (the first by a hash of their ids).
    generated: rows of generated strings, each of several kinds. smooth: how many shared observations each
    character is followed by. least, each: log-likelihood ratio of a secret, in nats, in all and per character."""

    documents: int = 500
    generated: int = 4_000
    smooth: float = 20.0
    least: float = 18.0
    each: float = 1.1


def _digest(name: str, n: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"quern {name} "), n).cast("binary"), 256)


def random_strings(n: Column, name: str = "random") -> list[Column]:
    """Random strings of a number: base 64 with either pair of signs, letters and digits, and one case of them."""
    base64 = F.base64(F.unhex(_digest(name, n)))
    plain = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    return [F.substring(base64, 1, 40), F.translate(F.substring(base64, 1, 43), "+/", "-_"), plain, F.upper(plain), F.lower(plain)]


def ordinary_strings(n: Column, words: Sequence[str] = IDENTIFIER_WORDS, name: str = "plain") -> list[Column]:
    """Long strings of a number that are no secrets: UUIDs, rules, decimal numbers, dates with times, and four
    words in camel case, with signs and in capitals."""
    d = _digest(name, n)
    some = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(n, k), F.lit(len(words))) + 1).cast("int")))
    camel = F.array_join(F.transform(some, F.initcap), "")
    digits = F.regexp_replace(F.concat(d, F.reverse(d)), "[^0-9]", "")
    part = lambda a, k: F.substring(d, a, k)
    digit = lambda a, k: F.substring(digits, a, k)
    rule = F.repeat(F.element_at(F.array(*map(F.lit, "-=_+/")), (F.pmod(n.cast("long"), F.lit(5)) + 1).cast("int")), 24)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    date = F.concat(F.lit("20"), digit(1, 2), F.lit("-"), digit(3, 2), F.lit("-"), digit(5, 2), F.lit("T"), digit(7, 2), F.lit("-"), digit(9, 2), F.lit("-"), digit(11, 2))
    return [uuid, F.upper(uuid), rule, F.substring(digits, 1, 22), date, camel, F.array_join(some, "_"), F.upper(F.array_join(some, "_")), F.array_join(some, "/"), F.array_join(some, "")]


def labelled_samples(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] = IDENTIFIER_WORDS) -> DataFrame:  # noqa: B008
    """Rows (sample, secret): random strings made from digests; UUIDs, rules, numbers and dates; and the words of
    a bounded number of documents, alone, and as identifiers of two to four of them joined by signs, by capitals
    and with numbers. Words with two digits in a row are left out, as documents hold secrets."""
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    made = spark.range(s.generated).select(
        F.explode(F.concat(
            F.transform(F.array(*random_strings(n)), lambda x: F.struct(x.alias("sample"), F.lit(1).alias("secret"))),
            F.transform(F.array(*ordinary_strings(n, words)), lambda x: F.struct(x.alias("sample"), F.lit(0).alias("secret"))),
        )).alias("x")
    ).select("x.*")
    # ids are chosen before texts are read: what is broadcast has `documents` rows at most, and tasks share the work
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = own.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(s.documents)
    some = own.join(F.broadcast(chosen), "id")
    own_words = F.filter(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0)), lambda w: ~w.rlike("[0-9]{2}") & (F.length(w) <= 40))
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0)), F.lit(9))  # nine kinds of joins, so as many joined as plain
    number = lambda k: F.pmod(F.crc32(F.get("w", k).cast("binary")), F.lit(100_000)).cast("string")
    capital = lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 40))
    joins = [*map(_joining, ("_", "-", "/", "")),
             lambda k: F.array_join(F.transform(F.slice("w", k + 1, 4), capital), ""), lambda k: F.upper(F.array_join(F.slice("w", k + 1, 3), "_")),
             lambda k: F.concat_ws("_", F.get("w", k), number(k), F.get("w", k + 1), number(k + 1)), lambda k: F.concat_ws("-", F.get("w", k), F.get("w", k + 1), number(k)),
             lambda k: F.concat_ws("/", F.get("w", k), number(k), F.get("w", k + 1))]
    plain = some.select(own_words.alias("w")).select(F.explode(F.concat("w", *(F.transform(at, j) for j in joins))).alias("sample"), F.lit(0).alias("secret"))
    return made.unionByName(plain.where("length(sample) >= 4"))


def _joining(sign: str):
    return lambda k: F.array_join(F.slice("w", k + 1, 3), sign)


def _long_enough(pattern: str, group: int, least: int):
    return lambda m: F.length(F.regexp_extract(m, pattern, group) if group else m) >= least


def train(samples: DataFrame, smooth: float = 20.0) -> list[float]:
    """Log ratios of transitions, random over ordinary, by (from + 1) * size + to; row 0 is the start. Each
    probability is that of the counts and `smooth` more observations, spread as characters are in all samples;
    so pairs that neither kind of samples has say nothing. Characters outside the alphabet are passed over; rows
    with a null in either column count for nothing. With no samples all ratios are 0."""
    chars = samples.where("secret is not null").select("secret", F.expr(f"filter(split(sample, ''), c -> c <> '' and instr('{ALPHABET}', c) > 0)").alias("c"))
    pairs = chars.where("size(c) > 0").select("secret", F.explode(F.zip_with(F.concat(F.array(F.lit("")), "c"), F.col("c"), lambda a, b: F.concat_ws("\n", a, b))).alias("p"))
    size = len(ALPHABET)
    counts = {0: [0] * ((size + 1) * size), 1: [0] * ((size + 1) * size)}
    for r in pairs.where("p is not null").groupBy("secret", "p").count().collect():  # at most 2 * 68 * 67 rows
        a, _, b = r["p"].rpartition("\n")
        if b:
            counts[r["secret"]][(ALPHABET.index(a) + 1 if a else 0) * size + ALPHABET.index(b)] += r["count"]
    shared = [1.0] * size
    for c in counts.values():  # either kind has the same say
        for b in range(size):
            shared[b] += 1e6 * sum(c[b::size]) / max(1, sum(c))
    shared = [x / sum(shared) for x in shared]
    out = []
    for row in range(size + 1):
        one, two = (counts[k][row * size : (row + 1) * size] for k in (1, 0))
        p = lambda c, b, own: (c + smooth * shared[b]) / (sum(own) + smooth)  # noqa: B023, E731
        out += [math.log(p(x, b, one)) - math.log(p(y, b, two)) for b, (x, y) in enumerate(zip(one, two, strict=True))]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, random over ordinary."""
    size = len(ALPHABET)
    at = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weights = F.array(*map(F.lit, model))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, k: F.struct(k.alias("last"), (acc["sum"] + F.get(weights, acc["last"] * size + k - 1)).alias("sum"))
    return F.aggregate(at, start, step)["sum"]


def is_random(token: Column, model: list[float], s: Settings = Settings()) -> Column:  # noqa: B008
    """Whether the ratio of a token is high enough, in all and for each character."""
    return ratio(token, model) >= F.greatest(F.lit(s.least), s.each * F.length(token))


def _places(text: Column, matches: Column, pattern: str, kind: int, passed: Column) -> Column:
    """Spans of matches from what stands between them. passed: for each match, whether it counts."""
    empty = F.array().cast(SPAN)
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["pos"] + F.length(x["b"])
        e = a + F.length(x["m"])
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), e.alias("end")))
        return F.struct(e.alias("pos"), F.when(x["ok"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), passed.alias("ok"))
    return F.when(F.exists(passed, lambda x: x), F.aggregate(zipped, start, step)["spans"]).otherwise(empty)


def scan(docs: DataFrame, model: list[float], settings: Settings = Settings(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """docs with a column spans added: all spans (start, kind, end) by start, then kind. Offsets count code
    points, ends are exclusive, kind is a position in KINDS. A null or empty text has no spans. Every row is
    scanned by itself, so repeated rows and null ids are like any others; an empty table stays empty. All other
    columns are kept as they are; a column named spans is replaced."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    names = [f"m{k}" for k in range(len(PATTERNS) + 1)]
    out = rows.withColumn("text", F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    patterns = [*(p[1] for p in PATTERNS), TOKEN]
    out = out.withColumns({n: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for n, p in zip(names, patterns, strict=True)})
    found = []
    for kind, (n, (_, pattern, group, least)) in enumerate(zip(names, PATTERNS, strict=False)):
        passed = F.transform(F.col(n), _long_enough(pattern, group, least))
        found.append(_places(F.col("text"), F.col(n), pattern, kind, passed))
    random = F.transform(F.col(names[-1]), lambda t: is_random(t, model, settings))
    markov = _places(F.col("text"), F.col(names[-1]), TOKEN, len(PATTERNS), random)
    out = out.withColumn("base", F.concat(*found)).withColumn("more", markov)
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.select("row", F.array_sort(F.concat("base", apart)).alias("found"))
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != "spans"), F.col("found").alias("spans"))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of spans, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    own = F.filter(spans, lambda x: x["kind"].isin([KINDS.index(k) for k in kinds]))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def redacted(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one sign."""
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        part = F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int")), F.lit(sign))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when((x["start"] < acc["pos"]) & (acc["pos"] > 0), acc["out"]).otherwise(part).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def trained_on(docs: DataFrame, settings: Settings = Settings()) -> list[float]:  # noqa: B008
    """The model that scan() takes, learned from generated strings and words of docs (doc_id, text). Documents
    without an id or text teach nothing; with no documents at all, identifiers are the generated ones alone."""
    session(docs.sparkSession)
    return train(labelled_samples(docs, settings), settings.smooth)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, trained_on(docs))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    base = tuple(k for k in KINDS if k != "markov")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(listed(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("markov").alias("n_markov"),
    )


def _oracle_sql() -> str:
    """op4 in DuckDB: the base spans, from what stands between matches. The Markov model has no SQL; in the given
    tables no string but those of the patterns is random, so the query must add no span to these."""
    parts, spans = ["t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"], []
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"{name}_m AS (SELECT doc_id, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS b FROM t)")
        parts.append(
            f"{name}_s AS (SELECT doc_id, {kind} AS kind, g[k] AS g, list_sum([len(x) FOR x IN b[1:k]]) + coalesce(list_sum([len(x) FOR x IN m[1:k - 1]]), 0) AS a, len(m[k]) AS n "
            f"FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_m))"
        )
        spans.append(f"SELECT doc_id, kind, '{name}' AS name, a::BIGINT AS a, (a + n)::BIGINT AS e FROM {name}_s WHERE len(g) >= {least}")
    parts.append(f"span AS ({' UNION ALL '.join(spans)})")
    parts.append("listed AS (SELECT doc_id, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans, " + ", ".join(f"count(*) FILTER (name = '{k[0]}') AS n_{k[0]}" for k in PATTERNS) + " FROM span GROUP BY doc_id)")
    counts = ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in PATTERNS)
    return f"WITH {', '.join(parts)} SELECT doc_id, {counts}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, 0::BIGINT AS n_markov FROM t LEFT JOIN listed USING (doc_id)"


ORACLE_SQL = _oracle_sql()
