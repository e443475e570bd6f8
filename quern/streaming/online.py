"""Models that follow a stream: additive sums by micro-batches, per-key state, and windows with a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.linear import LinearRegression


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def online_regression(stream: DataFrame, features: Sequence[str], target: str, checkpoint: str) -> LinearRegression:
    """Recursive least squares over what the stream holds now: each micro-batch adds its sums. A batch that is
    run again after a failure is recognized by its number."""
    model, seen = LinearRegression(features, [target]), set()

    def take(batch: DataFrame, number: int) -> None:
        if number not in seen and not batch.isEmpty():
            model.update(batch)
        seen.add(number)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return model


def online_posteriors(stream: DataFrame, arm: str, success: str) -> DataFrame:
    """Beta posteriors (arm, alpha, beta) as state per arm, emitted with every batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b = state.get if state.exists else (1.0, 1.0)
        for pdf in batches:
            good = float(pdf["success"].sum())
            a, b = a + good, b + len(pdf) - good
        state.update((a, b))
        yield pd.DataFrame({"arm": [key[0]], "alpha": [a], "beta": [b]})

    rows = stream.select(F.col(arm).alias("arm"), F.col(success).cast("double").alias("success"))
    return rows.groupBy("arm").applyInPandasWithState(update, "arm string, alpha double, beta double", "alpha double, beta double", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and means by tumbling windows; later rows than the delay allows are dropped by the engine."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def collected(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What the stream gives now, in a table in memory."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
