"""Stream, source and generator queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators.vocabulary import lines
from quern.plans.common import rounded, shared_folder, table
from quern.sources import generators as G
from quern.sources import text as T
from quern.streaming import online as O


def _folder(spark) -> str:
    return f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/{uuid.uuid4().hex}"


def _regression(spark, sf):
    s = O.stream_of(spark, sf, "events").select((F.col("user_id") % 10).cast("double").alias("x"), F.col("value").alias("y"))
    m = O.online_regression(s, ["x"], "y", _folder(spark))
    return spark.createDataFrame([(t, round(float(v), 6)) for t, v in zip(("intercept", "x"), m.beta[:, 0], strict=True)], "term string, value double")


def _posteriors(spark, sf):
    s = O.stream_of(spark, sf, "events").withColumn("ok", F.col("value") > 50)
    return O.collected(O.online_posteriors(s, "event_type", "ok"), f"posteriors_{uuid.uuid4().hex}", "update", _folder(spark))


def _windows(spark, sf):
    w = O.collected(O.windowed(O.stream_of(spark, sf, "events"), "ts", "value"), f"windows_{uuid.uuid4().hex}", "complete", _folder(spark))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", rounded("mean", 9).alias("mean"))


def _lines(spark, sf):
    """Lines of a text source, written first and read back."""
    path = _folder(spark)
    table(spark, sf, "benchmark").select("text").write.text(path, lineSep="\n")
    read = T.read_lines(spark, path).groupBy(F.md5(F.col("line").cast("binary")).alias("line")).agg(F.count("*").alias("n"))
    return read.where("n > 0")


def _generated(spark, sf):
    made = {
        "tensor": G.random_tensor(spark, 50, 4), "binary": G.random_binary_tensor(spark, 50, 4), "one_hot": G.random_one_hot(spark, 50, 4), "stochastic": G.random_stochastic(spark, 50, 4),
    }
    rows = [(k, d.count(), G.is_binary(d), G.is_stochastic(d), G.is_one_hot(d), G.is_symmetric(d)) for k, d in made.items()]
    return spark.createDataFrame(rows, "kind string, n bigint, binary boolean, stochastic boolean, one_hot boolean, symmetric boolean")


def _sampled(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("event_type").alias("cat")).agg(F.count("*").alias("n"))
    probs = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("cat", (F.col("n") / F.col("t")).alias("p"))
    drawn = G.sample_categorical(table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw")), probs)
    few = G.sample_categorical(drawn, probs, replacement=False, n=3).withColumn("first", F.lit(True))
    return drawn.groupBy("cat").agg(F.count("*").alias("n")).join(few, "cat", "left")


def _paragraph(spark, sf):
    return G.random_paragraph(spark, 100).agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


QUERIES = {
    "stream_regression": _regression,
    "stream_posteriors": _posteriors,
    "stream_windows": _windows,
    "source_lines": _lines,
    "random_tensors": _generated,
    "sample_categorical": _sampled,
    "random_paragraph": _paragraph,
    "document_lines": lambda s, d: lines(table(s, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")),
}
ORACLES = {
    "stream_regression": """with e as (select (user_id % 10)::double as x, value as y from events) select 'intercept' as term, round(regr_intercept(y, x), 6) as value from e
 union all select 'x', round(regr_slope(y, x), 6) from e""",
    "stream_posteriors": "select event_type as arm, 1.0::double + sum((value > 50)::int) as alpha, 1.0::double + sum((value <= 50)::int) as beta from events group by 1",
    "stream_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, count(*)::bigint as n, round(avg(value), 9) as mean from events group by 1",
    "source_lines": "select md5(line) as line, count(*)::bigint as n from (select unnest(string_split(text, chr(10))) as line from benchmark) group by 1",
    "document_lines": "select doc_id, count(*)::bigint as n, sum(length(line))::bigint as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1",
}
