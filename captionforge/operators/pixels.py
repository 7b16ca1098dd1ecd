"""Rasters as relations: (img_id, y, x, r, g, b), one row per pixel, with the kernels as projections, aggregates and windows.

Neighbours are windows along rows and columns of an image, or prefix sums, never a self-join of pixels with all their neighbours.
Pixels that are missing at an image's ragged end are no neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row():
    return Window.partitionBy("img_id", "y").orderBy("x")


def column():
    return Window.partitionBy("img_id", "x").orderBy("y")


def gray() -> Column:
    return F.shiftright(F.col("r") * 77 + F.col("g") * 150 + F.col("b") * 29, 8)


def with_gray(px: DataFrame) -> DataFrame:
    return px.select("img_id", "y", "x", gray().cast("int").alias("v"))


def contrast(v: Column | str, by: float = 1.4) -> Column:
    """The value stretched around the middle in single precision, truncated, within a byte."""
    v = F.col(v) if isinstance(v, str) else v
    c = F.lit(by).cast("float")
    stretched = v.cast("float") * c + F.lit(128.0).cast("float") * (F.lit(1.0).cast("float") - c)
    return F.least(F.lit(255), F.greatest(F.lit(0), stretched.cast("int")))


def contrast_table(spark, by: float = 1.4) -> DataFrame:
    return spark.range(256).select(F.col("id").cast("int").alias("v"), contrast("id", by).cast("int").alias("out"))


def otsu_thresholds(values: DataFrame) -> DataFrame:
    """(img_id, threshold): of values (img_id, v), by a histogram of 256 rows an image and running sums over it."""
    hist = values.groupBy("img_id", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    run = hist.withColumns({"wb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("v")).over(upto), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("v")).over(whole)})
    wf = F.col("w") - F.col("wb")
    apart = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(wf > 0, wf)
    between = F.round(F.col("wb").cast("double") * wf * apart * apart, 4)
    best = run.withColumn("between", between).groupBy("img_id").agg(F.max_by("v", F.when(F.col("between") > 0, F.struct("between", (-F.col("v")).alias("first")))).alias("t"))
    return best.select("img_id", F.coalesce("t", F.lit(128)).alias("threshold"))


def otsu(values: DataFrame) -> DataFrame:
    """Black and white by each image's threshold."""
    met = values.join(otsu_thresholds(values), "img_id")
    return met.select("img_id", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def color_mask(px: DataFrame) -> DataFrame:
    """White where the colour is one that subtitles have, or much brighter than its four neighbours."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    base = px.select("img_id", "y", "x", "r", "g", "b", F.expr("(r + g + b) div 3").cast("int").alias("_l"), high.alias("_h"), low.alias("_m"))
    base = base.withColumn("_s", F.when(F.col("_h") == 0, 0).otherwise(F.expr("(_h - _m) * 255 div _h")))
    around = {"_a": F.lag("_l").over(row()), "_b": F.lead("_l").over(row()), "_c": F.lag("_l").over(column()), "_d": F.lead("_l").over(column())}
    base = base.withColumns(around)
    l, s = F.col("_l"), F.col("_s")
    plain = (l >= 150) & (s <= 80)
    yellow = (F.col("r") >= 180) & (F.col("g") >= 160) & (F.col("b") < 130) & (F.col("r") + F.col("g") > 360)
    cyan = (F.col("r") < 130) & (F.col("g") >= 180) & (F.col("b") >= 180)
    green = (F.col("g") >= 200) & (F.col("r") >= 150) & (F.col("b") < 130)
    stands_out = (l >= 130) & (s <= 100) & F.coalesce(l - F.expr("(_a + _b + _c + _d) div 4") > 40, F.lit(False))
    return base.select("img_id", "y", "x", F.when(plain | yellow | cyan | green | stands_out, 255).otherwise(0).alias("v"))


def spread(values: DataFrame, radius: int, take) -> DataFrame:
    """The extreme over squares of 2 radius + 1: along rows, then along columns."""
    for window in (row(), column()):
        values = values.withColumn("v", take("v").over(window.rangeBetween(-radius, radius)))
    return values


def dilate(values: DataFrame, radius: int = 1) -> DataFrame:
    return spread(values, radius, F.max)


def erode(values: DataFrame, radius: int = 1) -> DataFrame:
    return spread(values, radius, F.min)


def close_gaps(values: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(values, radius), radius)


def adaptive(values: DataFrame, block: int = 15, constant: int = 10) -> DataFrame:
    """White where a pixel is brighter than its block's mean less a constant: sums along rows, then sums of these along columns."""
    half = block // 2
    near = lambda w: w.rangeBetween(-half, half)
    rows = values.withColumns({"_s": F.sum("v").over(near(row())), "_n": F.count(F.lit(1)).over(near(row()))})
    both = rows.withColumns({"_s": F.sum("_s").over(near(column())), "_n": F.sum("_n").over(near(column()))})
    return both.select("img_id", "y", "x", F.when(F.col("v") > F.expr("_s div _n") - constant, 255).otherwise(0).alias("v"))


def region_score(values: DataFrame, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(img_id, total, bright, edges, contrasts, score): counts of pixels over a region's grey values, and how like text they are."""
    if region:
        x, y, w, h = region
        values = values.filter((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    change = F.greatest(F.abs(F.col("v") - F.lag("v").over(row())), F.abs(F.col("v") - F.lag("v").over(column())))
    inner = F.lag("v").over(row()).isNotNull() & F.lag("v").over(column()).isNotNull()
    counted = values.withColumn("_d", F.when(inner, change)).groupBy("img_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("v") > 200).alias("bright"), F.count_if(F.col("_d") > 50).alias("edges"), F.count_if(F.col("_d") > 100).alias("contrasts")
    )
    return counted.withColumn("score", ratio_score(F.col("bright") / F.col("total"), F.col("edges") / F.col("total"), F.col("contrasts") / F.col("total")))


def ratio_score(bright: Column, edge: Column, contrast: Column) -> Column:
    """Bands of the three shares, weighed 3, 4 and 3 of 10."""
    a = F.when(bright.between(0.02, 0.50), (1 - F.abs(bright - 0.15) / 0.35) * 0.3).otherwise(0.0)
    b = F.when(edge.between(0.005, 0.20), edge / 0.10 * 0.4).otherwise(0.0)
    c = F.when(contrast.between(0.002, 0.15), contrast / 0.05 * 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), a + b + c)
