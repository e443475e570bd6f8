"""Images in long form (ex, row, col, ch, v): patches, convolutions, pooling by equi-joins on coordinates.

Kernels (fr, fc, in_ch, out_ch, w) and offset tables have a fixed size, so they are broadcast; pixels move once,
in a sum by output place with partial sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_dim(n: int, k: int, stride: int = 1, pad: int = 0, dilation: int = 0) -> int:
    return (n + 2 * pad - (k + (k - 1) * dilation)) // stride + 1


def same_pad(n: int, out: int, k: int, stride: int = 1, dilation: int = 0) -> tuple[int, int]:
    """Zeros before and after for `out` places; the odd one comes after."""
    total = max(0, (out - 1) * stride + k + (k - 1) * dilation - n)
    return total // 2, total - total // 2


def causal_pad(k: int, dilation: int = 0) -> tuple[int, int]:
    return (k - 1) * (dilation + 1), 0


def fans(shape: tuple[int, ...]) -> tuple[int, int]:
    """Fan-in and fan-out of dense (in, out) or convolution (..., in, out) weights."""
    field = 1
    for n in shape[:-2]:
        field *= n
    return field * shape[-2], field * shape[-1]


def _grid(df: DataFrame, rows: int, cols: int) -> DataFrame:
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return df.select("ex", "ch").distinct().withColumn("row", F.explode(seq(rows))).withColumn("col", F.explode(seq(cols)))


def _filled(x: DataFrame, rows: int, cols: int) -> DataFrame:
    return _grid(x, rows, cols).join(x, ["ex", "ch", "row", "col"], "left").select("ex", "row", "col", "ch", F.coalesce("v", F.lit(0.0)).alias("v"))


def pad2d(x: DataFrame, shape: tuple[int, int], pad_rows: int, pad_cols: int) -> DataFrame:
    moved = x.withColumn("row", F.col("row") + pad_rows).withColumn("col", F.col("col") + pad_cols)
    return _filled(moved, shape[0] + 2 * pad_rows, shape[1] + 2 * pad_cols)


def dilate(x: DataFrame, shape: tuple[int, int], d: int) -> DataFrame:
    """d zeros between neighbouring pixels."""
    moved = x.withColumn("row", F.col("row") * (d + 1)).withColumn("col", F.col("col") * (d + 1))
    return _filled(moved, (shape[0] - 1) * (d + 1) + 1, (shape[1] - 1) * (d + 1) + 1)


def im2col(x: DataFrame, shape: tuple[int, int], kernel: tuple[int, int], stride: int = 1, pad: int = 0, dilation: int = 0) -> DataFrame:
    """(ex, out_row, out_col, fr, fc, ch, v): the pixels of each patch; those of the padding are left out as 0."""
    d = dilation + 1
    oh, ow = (out_dim(n, k, stride, pad, dilation) for n, k in zip(shape, kernel, strict=True))
    offsets = F.array(*(F.struct(F.lit(r).alias("fr"), F.lit(c).alias("fc")) for r in range(kernel[0]) for c in range(kernel[1])))
    p = x.withColumn("_o", F.explode(offsets)).select("ex", "row", "col", "ch", "v", "_o.fr", "_o.fc")
    p = p.withColumn("_r", F.col("row") + pad - F.col("fr") * d).withColumn("_c", F.col("col") + pad - F.col("fc") * d)
    p = p.where((F.pmod("_r", F.lit(stride)) == 0) & (F.pmod("_c", F.lit(stride)) == 0))
    p = p.withColumn("out_row", F.floor(F.col("_r") / stride).cast("int")).withColumn("out_col", F.floor(F.col("_c") / stride).cast("int"))
    return p.where(F.col("out_row").between(0, oh - 1) & F.col("out_col").between(0, ow - 1)).select("ex", "out_row", "out_col", "fr", "fc", "ch", "row", "col", "v")


def col2im(patches: DataFrame) -> DataFrame:
    """Sums patches back into their pixels."""
    return patches.groupBy("ex", "row", "col", "ch").agg(F.sum("v").alias("v"))


def conv2d(x: DataFrame, kernel: DataFrame, shape: tuple[int, int], size: tuple[int, int], stride: int = 1, pad: int = 0, dilation: int = 0) -> DataFrame:
    patches = im2col(x, shape, size, stride, pad, dilation)
    k = F.broadcast(kernel.withColumnRenamed("in_ch", "ch"))
    out = patches.join(k, ["fr", "fc", "ch"]).groupBy("ex", "out_row", "out_col", "out_ch").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("ex", F.col("out_row").alias("row"), F.col("out_col").alias("col"), F.col("out_ch").alias("ch"), "v")


def deconv2d(x: DataFrame, kernel: DataFrame, stride: int = 1, pad: int = 0) -> DataFrame:
    """Transposed convolution: each pixel adds the kernel, times its value, at its place."""
    k = F.broadcast(kernel.withColumnRenamed("in_ch", "ch"))
    spread = x.join(k, "ch").select("ex", (F.col("row") * stride + F.col("fr") - pad).alias("row"), (F.col("col") * stride + F.col("fc") - pad).alias("col"), F.col("out_ch").alias("ch"), (F.col("v") * F.col("w")).alias("v"))
    return spread.where("row >= 0 and col >= 0").groupBy("ex", "row", "col", "ch").agg(F.sum("v").alias("v"))


def pool2d(x: DataFrame, shape: tuple[int, int], size: tuple[int, int], stride: int = 1, pad: int = 0, mode: str = "max") -> DataFrame:
    """The largest value or the mean of each patch; padding counts as 0."""
    p = im2col(x, shape, size, stride, pad).groupBy("ex", "out_row", "out_col", "ch").agg(F.max("v").alias("hi"), F.sum("v").alias("sum"), F.count("*").alias("n"))
    n = size[0] * size[1]
    hi = F.when(F.col("n") < n, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    return p.select("ex", F.col("out_row").alias("row"), F.col("out_col").alias("col"), "ch", (hi if mode == "max" else F.col("sum") / n).alias("v"))
