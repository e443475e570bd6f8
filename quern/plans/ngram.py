"""N-gram queries: models of documents, scored on benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ngram as N
from quern.operators.vocabulary import lines
from quern.plans.common import rounded, table


def _lines(spark, sf):
    return lines(table(spark, sf, "documents"))


def _counts(n):
    return lambda spark, sf: N.gram_counts(_lines(spark, sf), n)


def _mle(spark, sf):
    model = N.MLENGram.train(_lines(spark, sf), 2)
    return model.probabilities(model.counts.select("gram")).select("gram", rounded("log_prob").alias("log_prob"))


def _mle_trigram_start(spark, sf):
    """Trigrams at the start of a line have a context too."""
    model = N.MLENGram.train(_lines(spark, sf), 3)
    return model.completions("<bol> <bol>").select("word", rounded("log_prob").alias("log_prob"))


def _additive(n, k):
    def run(spark, sf):
        model = N.AdditiveNGram.train(_lines(spark, sf), n)
        model.k = k
        out = model.log_prob(table(spark, sf, "benchmark"), "item_id")
        return out.select("id", "n_grams", rounded("log_prob", 5).alias("log_prob"), rounded("cross_entropy", 5).alias("cross_entropy"), rounded("perplexity", 3).alias("perplexity"))

    return run


def _good_turing_counts(spark, sf):
    return N.GoodTuringNGram.train(_lines(spark, sf), 2).smoothed().select("r", "nr", rounded("smoothed", 5).alias("smoothed"))


def _good_turing(spark, sf):
    out = N.GoodTuringNGram.train(_lines(spark, sf), 2).log_prob(table(spark, sf, "benchmark"), "item_id")
    return out.select("id", "n_grams", rounded("log_prob", 5).alias("log_prob"))


def _completions(spark, sf):
    return N.AdditiveNGram.train(_lines(spark, sf), 2).completions("the").select("word", rounded("log_prob").alias("log_prob"))


def _generate(spark, sf):
    model = N.MLENGram.train(lines(table(spark, sf, "benchmark"), "item_id"), 2)
    model.counts = model.counts.checkpoint()
    rows = [(k, len(s), " ".join(s)) for k, s in enumerate(model.generate(2, most=12))]
    return spark.createDataFrame(rows, "sentence int, n_words int, text string")


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def counts_sql(n: int, name: str = "g", source: str = "documents") -> str:
    p = max(1, n - 1)
    pad = f"list_concat([{', '.join(['$<bol>$'] * p)}], w, [{', '.join(['$<eol>$'] * p)}])".replace("$", "'") if n > 1 else "w"
    gram = f"array_to_string(w[i:i+{n - 1}], ' ')"
    return (
        f"{name}_l as (select unnest(string_split(text, chr(10))) as line from {source}), {name}_w as (select {WORDS.format('line')} as w from {name}_l), "
        f"{name}_p as (select {pad} as w from {name}_w where len(w) > 0), "
        f"{name} as (select gram, count(*)::bigint as count from (select unnest([{gram} for i in range(1, greatest(len(w) - {n} + 2, 1)::bigint)]) as gram from {name}_p) group by 1)"
    )


PREFIX = r"regexp_replace({}, ' ?[^ ]+$', '')"
LAST = "regexp_extract({}, '[^ ]+$')"


def _additive_sql(n: int, k: float) -> str:
    return f"""with {counts_sql(n)}, c as (select {PREFIX.format('gram')} as context, sum(count) as cc from g group by 1),
 v as (select count(distinct w) + 1 as v from (select {LAST.format('gram')} as w from g) where w not in ('<bol>', '<eol>')),
 q as (select item_id as id, {WORDS.format('text')} as w from benchmark),
 e as (select id, unnest([array_to_string(w[i:i+{n - 1}], ' ') for i in range(1, greatest(len(w) - {n} + 2, 1)::bigint)]) as gram from q where len(w) >= {n}),
 s as (select id, ln((coalesce(count, 0) + {k}::double) / (coalesce(cc, 0) + v * {k}::double)) as lp from e left join g using (gram) left join c on c.context = {PREFIX.format('e.gram')}, v),
 a as (select id, count(*)::bigint as n_grams, sum(lp) as lp from s group by 1)
 select id, n_grams, round(lp, 5) as log_prob, round(-lp / n_grams, 5) as cross_entropy, round(exp(-lp / n_grams), 3) as perplexity from a"""


SMOOTHED = f"""{counts_sql(2)}, coc as (select count as r, count(*)::bigint as nr from g group by 1),
 zz as (select r, nr, coalesce(lag(r) over (order by r), 0) as before, lead(r) over (order by r) as after, lead(nr) over (order by r) as nn from coc),
 z as (select r, nr, nr / (case when after is null then (r - before)::double else (after - before) / 2.0 end) as z, case when after = r + 1 then nn end as next from zz),
 f as (select regr_slope(ln(z), ln(r)) as slope, regr_intercept(ln(z), ln(r)) as intercept from z),
 m as (select r, nr, (r + 1) * exp(intercept + slope * ln(r + 1)) / exp(intercept + slope * ln(r)) as line, (r + 1) * next::double / nr as raw,
  1.96 * sqrt(pow(r + 1, 2) * next / pow(nr, 2) * (1 + next::double / nr)) as err, next from z, f),
 sm as (select r, nr, case when max((next is null or abs(raw - line) <= err)::int) over (order by r rows unbounded preceding) = 1 then line else raw end as smoothed from m)"""

QUERIES = {
    "ngram_counts_1": _counts(1),
    "ngram_counts_2": _counts(2),
    "ngram_counts_3": _counts(3),
    "ngram_mle": _mle,
    "ngram_mle_line_start": _mle_trigram_start,
    "ngram_additive_log_prob": _additive(2, 1.0),
    "ngram_additive_k": _additive(1, 0.5),
    "ngram_completions": _completions,
    "good_turing_counts": _good_turing_counts,
    "good_turing_log_prob": _good_turing,
    "ngram_generate": _generate,
}
ORACLES = {
    **{f"ngram_counts_{n}": f"with {counts_sql(n)} select gram, count from g" for n in (1, 2, 3)},
    "ngram_mle": f"""with {counts_sql(2)}, c as (select {PREFIX.format('gram')} as context, sum(count) as cc from g group by 1)
 select gram, round(ln(count::double / cc), 6) as log_prob from g join c on c.context = {PREFIX.format('gram')}""",
    "ngram_mle_line_start": f"""with {counts_sql(3)}, c as (select gram, count from g where {PREFIX.format('gram')} = '<bol> <bol>')
 select {LAST.format('gram')} as word, round(ln(count::double / (select sum(count) from c)), 6) as log_prob from c""",
    "ngram_additive_log_prob": _additive_sql(2, 1.0),
    "ngram_additive_k": _additive_sql(1, 0.5),
    "ngram_completions": f"""with {counts_sql(2)}, c as (select gram, count from g where {PREFIX.format('gram')} = 'the'),
 v as (select count(distinct w) + 1 as v from (select {LAST.format('gram')} as w from g) where w not in ('<bol>', '<eol>'))
 select {LAST.format('gram')} as word, round(ln((count + 1.0::double) / ((select sum(count) from c) + v)), 6) as log_prob from c, v""",
    "good_turing_counts": f"with {SMOOTHED} select r, nr, round(smoothed, 5) as smoothed from sm",
    "good_turing_log_prob": f"""with {SMOOTHED}, v as (select count(distinct w) + 1 as v from (select {LAST.format('gram')} as w from g) where w not in ('<bol>', '<eol>')),
 t as (select sum(r * nr)::double as total, sum(smoothed * nr) as mass, coalesce(sum(case when r = 1 then nr end), 0)::double as n1, sum(nr) as seen, (select v from v)::double as v from sm),
 q as (select item_id as id, {WORDS.format('text')} as w from benchmark),
 e as (select id, unnest([array_to_string(w[i:i+1], ' ') for i in range(1, greatest(len(w), 1)::bigint)]) as gram from q where len(w) >= 2),
 s as (select id, ln(case when smoothed is not null then (1 - n1 / total) * smoothed / mass else n1 / total / greatest(v * v - seen, 1) end) as lp from e left join g using (gram) left join sm on sm.r = g.count, t)
 select id, count(*)::bigint as n_grams, round(sum(lp), 5) as log_prob from s group by 1""",
}
