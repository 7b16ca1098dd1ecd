"""Regions: where subtitles stand in a frame, and the maps between a frame and its picture on a screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels

LIKELY = 0.15


def col(c: Column | str | int) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, int) else c


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)])


def div(a: Column, n: int) -> Column:
    """a / n for a that isn't negative, as an integer."""
    return F.floor(a / n).cast("int")


def share(a: Column, x: float) -> Column:
    return (a * x).cast("int")


def candidates(width: Column | str, height: Column | str) -> Column:
    """An array of (ord, region, priority): where subtitles are looked for. (Fixed values.)"""
    w, h = col(width), col(height)
    places = [
        (rect(div(w, 6), share(h, 0.78), div(w * 2, 3), share(h, 0.18)), 1.0),
        (rect(F.lit(0), share(h, 0.75), w, share(h, 0.22)), 0.9),
        (rect(div(w, 10), share(h, 0.80), div(w * 4, 5), share(h, 0.16)), 0.85),
        (rect(div(w, 6), share(h, 0.02), div(w * 2, 3), share(h, 0.12)), 0.5),
    ]
    return F.array(*[F.struct(F.lit(k).alias("ord"), r.alias("region"), F.lit(p).alias("priority")) for k, (r, p) in enumerate(places)])


def intersection(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - x)
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - y)
    return rect(x, y, w, h)


def refine(region: Column, width: Column | str, height: Column | str) -> Column:
    """The region with a twentieth of its width and a tenth of its height around it, within the frame."""
    px, py = div(region["w"], 20), div(region["h"], 10)
    x, y = F.greatest(F.lit(0), region["x"] - px), F.greatest(F.lit(0), region["y"] - py)
    return rect(x, y, F.least(col(width) - x, region["w"] + px * 2), F.least(col(height) - y, region["h"] + py * 2))


def scored_candidates(values: DataFrame, width: int, height: int) -> DataFrame:
    """(img_id, width, height, ord, region, priority, score): grey values (img_id, y, x, v) scored in each candidate's own rectangle.

    A pixel goes to the candidates that it lies in, four at most, and neighbours are those within the rectangle.
    """
    found = F.filter(candidates(F.lit(width), F.lit(height)), lambda c: (F.col("x") >= c["region"]["x"]) & (F.col("x") < c["region"]["x"] + c["region"]["w"]) & (F.col("y") >= c["region"]["y"]) & (F.col("y") < c["region"]["y"] + c["region"]["h"]))
    each = values.withColumn("c", F.explode(found)).select(F.struct("img_id", "c").alias("img_id"), "y", "x", "v")
    score = pixels.region_score(each)
    return score.select("img_id.img_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "img_id.c.ord", "img_id.c.region", "img_id.c.priority", "score")


def best_region(scored: DataFrame, keys: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """keys, x, y, w, h, confidence: of scored candidates (keys, ord, region, priority, score, and the frame's size) the best, padded.

    The first of equals is taken, and the first of all where none scores.
    """
    value = F.col("score") * F.col("priority")
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("region", width, height), F.struct(value.alias("v"), (-F.col("ord")).alias("o"))).alias("b"), F.max(value).alias("v"))
    padded = best.select(*keys, refine(F.col("b.region"), F.col(f"b.{width}"), F.col(f"b.{height}")).alias("r"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("v")) * 100).alias("confidence"))
    return padded.select(*keys, "r.x", "r.y", "r.w", "r.h", "confidence")


def region_of_frames(regions: DataFrame, key: str = "video_id", order: str = "ts_ms") -> DataFrame:
    """key, x, y, w, h, confidence: the mean of a video's regions by confidence, truncated; the first one if none has any."""
    some = F.sum("confidence") > 0
    return regions.groupBy(key).agg(*[F.when(some, F.round(F.try_divide(F.sum(F.col(c) * F.col("confidence")), F.sum("confidence")), 6).cast("int")).otherwise(F.min_by(c, order)).alias(c) for c in "xywh"], F.max("confidence").alias("confidence"))


def has_subtitle(score: Column | str) -> Column:
    return col(score) > LIKELY


def fit(image_w: Column, image_h: Column, shown_w: Column, shown_h: Column) -> tuple[Column, Column, Column]:
    """Scale of a picture that fits into an area, and its offsets there."""
    scale = F.least(shown_w / image_w, shown_h / image_h)
    offset = lambda shown, image: ((shown - (image * scale).cast("int")) / 2).cast("int")
    return scale, offset(shown_w, image_w), offset(shown_h, image_h)


def to_image(x, y, image_w, image_h, shown_w, shown_h) -> Column:
    """(x, y) in a frame of a point of its picture, within the frame."""
    iw, ih, sw, sh = map(col, (image_w, image_h, shown_w, shown_h))
    scale, ox, oy = fit(iw, ih, sw, sh)
    within = lambda v, o, n: F.greatest(F.lit(0), F.least(((col(v) - o) / scale).cast("int"), n.cast("int")))
    return F.struct(within(x, ox, iw).alias("x"), within(y, oy, ih).alias("y"))


def to_display(region: Column, image_w, image_h, shown_w, shown_h) -> Column:
    scale, ox, oy = fit(*map(col, (image_w, image_h, shown_w, shown_h)))
    at = lambda c: (region[c] * scale).cast("int")
    return rect(ox + at("x"), oy + at("y"), at("w"), at("h"))


def drag_is_valid(w: Column | str, h: Column | str) -> Column:
    return (col(w) > 10) & (col(h) > 10)


def roi_is_valid(w: Column | str, h: Column | str) -> Column:
    return (col(w) >= 10) & (col(h) >= 10)
