"""Benchmark passages in documents, found by spaced seeds, with DataFrame functions alone.

A mask takes some tokens of a short window and ignores the others, so its hash survives a substitution at an
ignored place. Hashes of all benchmark windows are joined with those of all document windows; around each hit
the two texts are laid over each other without gaps, and the overlap counts where a stretch of it agrees in
most tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import session, table, text_key

WORD = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Scheme:
    """masks: places of a window that are hashed, for items of `short` tokens or more; with these two, every way
    of placing the substitutions that verification allows leaves a hit. short_masks do the same for items of
    `least` to short - 1 tokens (all placements were tried, for 6 to 32 tokens); documents are hashed with them
    only where there are such items. Items of fewer than `least` tokens are no evidence. window and share: an
    overlap counts if `window` tokens in a row (or all of a shorter item) agree in that share of places.
    most_broadcast, most_bytes: rows of the seed table, and bytes of items, up to which both are broadcast;
    beyond that the joins are shuffled."""

    masks: tuple[tuple[int, ...], ...] = ((0, 2, 3, 4, 5), (0, 1, 2, 4, 5))
    short_masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3), (0, 1, 3, 4))
    least: int = 6
    short: int = 13
    window: int = 16
    share: float = 0.8
    most_broadcast: int = 1_000_000
    most_bytes: int = 64 << 20


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _hashes(pos: Column, masks: tuple[tuple[int, ...], ...], first: int) -> list[Column]:
    """What each mask takes of tok from pos on, hashed; null where it would reach beyond the end."""
    took = lambda k, mask: F.xxhash64(F.lit(first + k), *(F.get("tok", pos + o) for o in mask))
    return [F.when(pos + max(mask) < F.size("tok"), took(k, mask)) for k, mask in enumerate(masks)]


def _seeds(df: DataFrame, s: Scheme, pos: str, long: bool, short: bool) -> DataFrame:
    """A row for each window and mask of tok: pos, and the hash h of the tokens that the mask takes."""
    at = df.where(F.size("tok") >= s.least).withColumn(pos, F.explode(F.sequence(F.lit(0), F.size("tok") - 1)))
    hashes = (_hashes(F.col(pos), s.masks, 0) if long else []) + (_hashes(F.col(pos), s.short_masks, len(s.masks)) if short else [])
    return at.withColumn("h", F.explode(F.array(*hashes))).where("h is not null")


def _agreement(s: Scheme) -> tuple[Column, Column, Column]:
    """For a hit (tok, item, diag): which places of the item agree, the window, and the agreements needed."""
    same = F.transform("item", lambda t, k: F.when((F.col("diag") + k >= 0) & (F.col("diag") + k < F.size("tok")), (F.get("tok", F.col("diag") + k.cast("int")) == t).cast("int")).otherwise(0))
    window = F.least(F.lit(s.window), F.size("item"))
    return same, window, F.ceil(window * s.share).cast("int")


def _verified(hits: DataFrame, s: Scheme) -> DataFrame:
    same, window, need = _agreement(s)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    out = hits.withColumn("same", same).withColumn("matched", total(F.col("same"))).where(F.col("matched") >= need)
    starts = F.sequence(F.lit(1), F.size("item") - window + 1)
    return out.where(F.exists(starts, lambda k: total(F.slice("same", k, window)) >= need))


def contaminated(docs: DataFrame, benchmark: DataFrame, scheme: Scheme = Scheme(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:  # noqa: B008
    """Rows (doc_id, text_key, item_id, item_tokens, matched, doc_start): the documents that hold a passage of
    an item, with the tokens that agree on the best overlay and the place in the document where the item would
    begin.

    Every row of docs is a document of its own: rows that share an id, null or not, are told apart by text_key,
    the hash of their text, and rows that share both give one row. Rows that repeat an item repeat nothing; rows
    that share an item id are all searched for, and the best counts. Null and empty texts match nothing, nor do
    items of fewer than scheme.least tokens. Other columns are ignored. Whether seeds and items are broadcast or
    shuffled depends on their counted size; results are the same.
    """
    session(docs.sparkSession)
    s = scheme
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("tok")).where(F.size("tok") >= s.least).distinct()
    long, short = items.where(F.size("tok") >= s.short), items.where(F.size("tok") < s.short)
    size = items.agg(F.count_if(F.size("tok") < s.short), F.sum(F.size("tok")), F.sum(F.length(F.array_join("tok", " ")))).first()
    own = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), tokens(F.col(text_col)).alias("tok"))
    of_docs = _seeds(own, s, "p", True, size[0] > 0)
    seeds = _seeds(long, s, "q", True, False).unionByName(_seeds(short, s, "q", False, True)).select("h", "item_id", "q", F.col("tok").alias("item"))
    # a window gives a seed for each mask at most
    if (size[1] or 0) * max(len(s.masks), len(s.short_masks)) <= s.most_broadcast and (size[2] or 0) <= s.most_bytes:
        numbered = F.broadcast(items.select(F.xxhash64("tok").alias("item_key"), F.col("tok").alias("item"), "item_id"))
        thin = F.broadcast(seeds.select("h", F.xxhash64("item").alias("item_key"), "q").distinct())
        hits = of_docs.join(thin, "h").withColumn("diag", F.col("p") - F.col("q"))
        hits = hits.join(numbered, "item_key")
    else:
        thin = of_docs.select("doc_id", "text_key", "p", "h").join(seeds.select("h", F.xxhash64("item").alias("item_key"), "q").distinct(), "h")
        thin = thin.select("doc_id", "text_key", "item_key", (F.col("p") - F.col("q")).alias("diag")).distinct()
        texts = own.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "tok")
        hits = thin.join(items.select(F.xxhash64("tok").alias("item_key"), F.col("tok").alias("item"), "item_id"), "item_key")
        hits = hits.join(texts, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return (
        _verified(hits.select("doc_id", "text_key", "item_id", "diag", "tok", "item"), s)
        .groupBy("doc_id", "text_key", "item_id")
        .agg(
            F.max(F.size("item")).cast("long").alias("item_tokens"), F.max("matched").cast("long").alias("matched"),
            F.max_by(F.col("diag"), F.struct("matched", -F.col("diag"))).cast("long").alias("doc_start"),
        )
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def _oracle_sql(s: Scheme = Scheme()) -> str:  # noqa: B008
    """op7 in DuckDB: seeds as the words themselves, and the same verification."""
    def seeds(source: str, pos: str, masks: tuple[tuple[int, ...], ...], first: int, where: str) -> str:
        took = lambda m: "[" + ", ".join(f"tok[{pos} + {o + 1}]" for o in m) + "]"
        own = [f"SELECT id, {pos}, {first + k} AS mask, {took(m)} AS h FROM (SELECT id, tok, unnest(range(0, len(tok))) AS {pos} FROM {source} WHERE {where}) WHERE {pos} + {max(m)} < len(tok)" for k, m in enumerate(masks)]
        return " UNION ALL ".join(own)

    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    long, short = f"len(tok) >= {s.short}", f"len(tok) >= {s.least} AND len(tok) < {s.short}"
    of_items = f"{seeds('item', 'q', s.masks, 0, long)} UNION ALL {seeds('item', 'q', s.short_masks, len(s.masks), short)}"
    of_docs = seeds("doc", "p", (*s.masks, *s.short_masks), 0, f"len(tok) >= {s.least}")
    return f"""
WITH doc AS (SELECT doc_id AS id, {words('text')} AS tok FROM documents),
item AS (SELECT item_id AS id, {words('text')} AS tok FROM benchmark),
hit AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id, p - q AS diag FROM ({of_docs}) d JOIN ({of_items}) i ON d.mask = i.mask AND d.h = i.h),
laid AS (
  SELECT doc_id, item_id, diag, len(item.tok) AS n, least({s.window}, len(item.tok)) AS win,
    [CASE WHEN diag + k >= 0 AND diag + k < len(doc.tok) AND doc.tok[diag + k + 1] = item.tok[k + 1] THEN 1 ELSE 0 END FOR k IN range(0, len(item.tok))] AS same
  FROM hit JOIN doc ON doc.id = doc_id JOIN item ON item.id = item_id
), ok AS (
  SELECT doc_id, item_id, diag, n, list_sum(same) AS matched FROM laid
  WHERE list_max([list_sum(same[k:k + win - 1]) FOR k IN range(1, n - win + 2)]) >= ceil(win * {s.share}::DOUBLE)
)
SELECT doc_id, item_id, max(n)::BIGINT AS item_tokens, max(matched)::BIGINT AS matched, arg_max(diag, matched::BIGINT * 1000000000 - diag)::BIGINT AS doc_start FROM ok GROUP BY doc_id, item_id
"""


ORACLE_SQL = _oracle_sql()
