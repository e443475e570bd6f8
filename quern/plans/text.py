"""Text queries: tokenizers, vocabularies, tf-idf, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import vocabulary as V
from quern.plans.common import rounded, table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _digest(make):
    """Per document: the number of tokens and a digest of them."""

    def run(spark, sf):
        return _docs(spark, sf).select("doc_id", make(F.col("text")).alias("t")).select(
            "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "|").cast("binary")).alias("digest")
        )

    return run


def _digest_sql(tokens: str) -> str:
    return f"select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, '|')) as digest from (select doc_id, {tokens} as t from documents)"


def _tokens(spark, sf):
    return V.token_rows(_docs(spark, sf))


def _lines_count(spark, sf):
    return V.lines(_docs(spark, sf)).agg(F.count("*").alias("n"))


TOKENS_SQL = f"tok as (select doc_id, unnest({WORDS_SQL}) as token from documents)"
COUNTS_SQL = f"with {TOKENS_SQL}, c as (select token, count(*)::bigint as count from tok group by 1)"


def tfidf_documents(spark, sf):
    docs = _docs(spark, sf)
    out = V.tfidf(V.token_rows(docs), docs.agg(F.count("*").alias("n")))
    return out.select("doc_id", "token", "tf", rounded("tfidf").alias("tfidf"))


def tfidf_min_count(spark, sf):
    docs = _docs(spark, sf)
    rows = V.token_rows(docs)
    vocab = V.Vocabulary.fit(rows, min_count=5)
    out = V.tfidf(vocab.filter(rows), docs.agg(F.count("*").alias("n")), smooth=False)
    return out.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), rounded(F.sum("tfidf"), 3).alias("tfidf"))


def vocab_counts(spark, sf):
    return V.Vocabulary.fit(_tokens(spark, sf), n_lines=_lines_count(spark, sf)).tokens


def vocab_min_count(spark, sf):
    return V.Vocabulary.fit(_tokens(spark, sf), min_count=3).tokens


def vocab_max_tokens(spark, sf):
    return V.Vocabulary.fit(_tokens(spark, sf), max_tokens=500).tokens


def vocab_most_common(spark, sf):
    return V.Vocabulary.fit(_tokens(spark, sf)).most_common(25).select("token", "count")


def vocab_words_with_count(spark, sf):
    return V.Vocabulary.fit(_tokens(spark, sf)).words_with_count(2).select("token", "count")


def _vocab_of_documents_on_conversations(spark, sf):
    own = V.Vocabulary.fit(_tokens(spark, sf), min_count=3)
    return own, V.token_rows(table(spark, sf, "conversations"), id_col="conv_id")


def vocab_filter_unk(spark, sf):
    own, rows = _vocab_of_documents_on_conversations(spark, sf)
    return own.filter(rows).groupBy("conv_id", "token").agg(F.count("*").alias("n"))


def vocab_filter_drop(spark, sf):
    own, rows = _vocab_of_documents_on_conversations(spark, sf)
    return own.filter(rows, unk=False).groupBy("conv_id", "token").agg(F.count("*").alias("n"))


def vocab_words_to_indices(spark, sf):
    own, rows = _vocab_of_documents_on_conversations(spark, sf)
    return own.words_to_indices(rows).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("idx").alias("sum_idx"))


def vocab_indices_to_words(spark, sf):
    own, _ = _vocab_of_documents_on_conversations(spark, sf)
    ids = table(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("idx")).distinct()
    return own.indices_to_words(ids)


def bytes_round_trip(spark, sf):
    back = T.bytes_to_chars(T.utf8_bytes(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.size(T.utf8_bytes(F.col("text"))).cast("bigint").alias("n_bytes"), (back == F.col("text")).alias("same"))


def strip_punctuation(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.strip_punctuation(F.col("text")).cast("binary")).alias("digest"))


def ngram_rows(spark, sf):
    words = _docs(spark, sf).select("doc_id", T.tokenize_words(F.col("text"), stop=None).alias("w"))  # once per row, not per n-gram
    grams = words.select("doc_id", F.explode(T.ngrams(F.col("w"), 3)).alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def bpe_pair_counts(spark, sf):
    words = V.lines(_docs(spark, sf)).groupBy("line").agg(F.count("*").alias("n"))
    words = words.select(T.utf8_bytes(F.col("line")).cast("array<string>").alias("symbols"), "n")
    return V.pair_counts(words)


def bpe_fit_transform(spark, sf):
    """Learns merges on benchmark lines and encodes all benchmark texts."""
    items = table(spark, sf, "benchmark")
    model = V.BytePairEncoder.fit(V.lines(items, "item_id"), max_merges=20)
    coded = items.select("item_id", "text", model.transform(F.col("text")).alias("codes"))
    return coded.select("item_id", F.size("codes").alias("n_codes"), (model.inverse_transform(F.col("codes")) == F.col("text")).alias("same"))


def _chars(spark, sf):
    return V.token_rows(_docs(spark, sf), tokens=T.tokenize_chars(F.col("text")))


def huffman_symbol_counts(spark, sf):
    return _chars(spark, sf).groupBy("token").agg(F.count("*").alias("n"))


def huffman_codes(spark, sf):
    """Codes of the characters, with their lengths and how often each is used."""
    rows = _chars(spark, sf)
    model = V.HuffmanEncoder.fit(rows)
    return model.transform(rows.groupBy("token").agg(F.count("*").alias("n"))).select("token", "code", "n", F.length("code").alias("bits"))


def huffman_round_trip(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(T.tokenize_chars(F.col("text"))).alias("pos", "token"))
    model = V.HuffmanEncoder.fit(rows)
    coded = model.transform(rows)
    back = model.inverse_transform(coded.withColumnRenamed("token", "was"))
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("bits"), F.bool_and(F.col("token") == F.col("was")).alias("same"))


_STOPPED = f"list_filter({{}}, lambda w: lower(w) not in ({STOP_SQL}))"
_BYTES = "[('0x' || substr(hex({0}), 2*i-1, 2))::int for i in range(1, (len(hex({0}))//2 + 1)::bigint)]"


def _strip(sql: str) -> str:
    signs = T.PUNCTUATION.replace("'", "''")
    return rf"regexp_replace(translate({sql}, '{signs}', ''), '^\s+|\s+$', '', 'g')"


_TO_CHARS = "list_filter(string_split(regexp_replace(" + _strip("lower(text)") + ", ' {2,}', ' ', 'g'), ''), lambda c: c <> '')"

QUERIES = {
    "tfidf_documents": tfidf_documents,
    "tfidf_min_count": tfidf_min_count,
    "vocab_counts": vocab_counts,
    "vocab_min_count": vocab_min_count,
    "vocab_max_tokens": vocab_max_tokens,
    "vocab_most_common": vocab_most_common,
    "vocab_words_with_count": vocab_words_with_count,
    "vocab_filter_unk": vocab_filter_unk,
    "vocab_filter_drop": vocab_filter_drop,
    "vocab_words_to_indices": vocab_words_to_indices,
    "vocab_indices_to_words": vocab_indices_to_words,
    "tokenize_words": _digest(lambda c: T.tokenize_words(c, stop=None)),
    "tokenize_words_with_signs": _digest(lambda c: T.tokenize_words(c, stop=None, filter_punctuation=False)),
    "tokenize_whitespace": _digest(lambda c: T.tokenize_whitespace(c, stop=None)),
    "tokenize_chars": _digest(T.tokenize_chars),
    "tokenize_words_bytes": _digest(lambda c: T.tokenize_words_bytes(c, stop=None)),
    "tokenize_bytes_raw": _digest(T.tokenize_bytes_raw),
    "remove_stop_words": _digest(T.tokenize_words),
    "bytes_to_chars": bytes_round_trip,
    "strip_punctuation": strip_punctuation,
    "ngrams": ngram_rows,
    "bpe_pair_counts": bpe_pair_counts,
    "bpe_fit_transform": bpe_fit_transform,
    "huffman_symbol_counts": huffman_symbol_counts,
    "huffman_codes": huffman_codes,
    "huffman_round_trip": huffman_round_trip,
}

_VOCAB3 = f"""{TOKENS_SQL}, c0 as (select token, count(*) as n from tok group by 1),
 c as (select case when n < 3 then '<unk>' else token end as token, sum(n)::bigint as count from c0 group by 1),
 v as (select token, count, (row_number() over (order by token) - 1)::bigint as idx from c),
 conv as (select conv_id, unnest({WORDS_SQL}) as token from conversations)"""

ORACLES = {
    "tfidf_documents": f"""with {TOKENS_SQL}, tf as (select doc_id, token, count(*)::bigint as tf from tok group by 1, 2),
 df as (select token, count(*) as df from tf group by 1), d as (select count(*) as n from documents)
 select doc_id, token, tf, round(tf * (ln((n + 1)::double / (df + 1)) + 1), 6) as tfidf from tf join df using (token), d""",
    "tfidf_min_count": f"""with {TOKENS_SQL}, c as (select token, count(*) as n from tok group by 1),
 t2 as (select doc_id, case when n < 5 then '<unk>' else token end as token from tok join c using (token)),
 tf as (select doc_id, token, count(*)::bigint as tf from t2 group by 1, 2), df as (select token, count(*) as df from tf group by 1),
 d as (select count(*) as n from documents)
 select token, count(*)::bigint as df, sum(tf)::bigint as tf, round(sum(tf * (ln(n::double / df) + 1)), 3) as tfidf from tf join df using (token), d group by 1""",
    "vocab_counts": f"""{COUNTS_SQL}, l as (select sum(len(string_split(text, chr(10))))::bigint as n from documents),
 a as (select * from c union all select unnest(['<bol>', '<eol>']), n from l)
 select token, count, (row_number() over (order by token) - 1)::bigint as idx from a""",
    "vocab_min_count": f"with {_VOCAB3} select token, count, idx from v",
    "vocab_max_tokens": f"""{COUNTS_SQL}, r as (select *, row_number() over (order by count desc, token) as k from c),
 a as (select case when k <= 500 then token else '<unk>' end as token, sum(count)::bigint as count from r group by 1)
 select token, count, (row_number() over (order by token) - 1)::bigint as idx from a""",
    "vocab_most_common": f"{COUNTS_SQL} select token, count from c order by count desc, token limit 25",
    "vocab_words_with_count": f"{COUNTS_SQL} select token, count from c where count = 2",
    "vocab_filter_unk": f"with {_VOCAB3} select conv_id, coalesce(v.token, '<unk>') as token, count(*)::bigint as n from conv left join v using (token) group by 1, 2",
    "vocab_filter_drop": f"with {_VOCAB3} select conv_id, token, count(*)::bigint as n from conv where token in (select token from v) group by 1, 2",
    "vocab_words_to_indices": f"""with {_VOCAB3} select conv_id, count(*)::bigint as n, sum(coalesce(idx, (select idx from v where token = '<unk>')))::bigint as sum_idx
 from conv left join v using (token) group by 1""",
    "vocab_indices_to_words": f"with {_VOCAB3} select distinct o_orderkey % 1000 as idx, v.token from orders left join v on v.idx = o_orderkey % 1000",
    "tokenize_words": _digest_sql(WORDS_SQL),
    "tokenize_words_with_signs": _digest_sql(r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^a-zA-Z0-9\s]')"),
    "tokenize_whitespace": _digest_sql(r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"),
    "tokenize_chars": _digest_sql(_TO_CHARS),
    "tokenize_words_bytes": _digest_sql(f"[array_to_string({_BYTES.format('w')}, ' ') for w in {WORDS_SQL}]"),
    "tokenize_bytes_raw": _digest_sql(f"[array_to_string({_BYTES.format('text')}, ' ')]"),
    "remove_stop_words": _digest_sql(_STOPPED.format(WORDS_SQL)),
    "bytes_to_chars": "select doc_id, strlen(text)::bigint as n_bytes, true as same from documents",
    "strip_punctuation": f"select doc_id, md5({_strip('text')}) as digest from documents",
    "ngrams": f"""with t as (select doc_id, {WORDS_SQL} as w from documents),
 g as (select doc_id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, greatest(len(w) - 1, 1)::bigint)]) as gram from t)
 select gram, count(*)::bigint as n, count(distinct doc_id)::bigint as docs from g group by 1""",
    "bpe_pair_counts": f"""with l as (select unnest(string_split(text, chr(10))) as line from documents), b as (select {_BYTES.format('line')} as b from l),
 p as (select unnest([b[i]::varchar || ' ' || b[i+1]::varchar for i in range(1, greatest(len(b), 1)::bigint)]) as pair from b)
 select pair, count(*)::bigint as n from p group by 1""",
    "huffman_symbol_counts": f"with t as (select unnest({_TO_CHARS}) as token from documents) select token, count(*)::bigint as n from t group by 1",
}
