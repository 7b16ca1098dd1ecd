"""Recognition: the engine's contract, confidences of lines, the choice among passes, rates of empty frames.

No engine is in here. One is anything with a name and `recognize(pixels) -> (text, confidence)`; it is called where frames are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions import text as tx
from captionforge.schema import OCR

from .folds import quality

#: Passes in the order they are tried, and those that stand in where none of them reads anything. (Fixed values.)
PASSES, FALLBACKS = ("ColorBased", "Otsu", "Adaptive"), ("Raw", "Invert")
#: A pass as good as this, with so many characters, is the last.
ENOUGH, LONG_ENOUGH = 92.0, 3


class Engine(Protocol):
    name: str

    def recognize(self, pixels: np.ndarray) -> tuple[str, float]:
        """Text and confidence (0 to 100) of an RGB image; no text where there is none."""


def adjusted(confidence: Column | str, text: Column | str) -> Column:
    """Seven tenths of the confidence, and up to 30 for the text's quality."""
    return tx.col(confidence) * 0.7 + tx.quality_of(text) * 30


def lines(words: DataFrame) -> DataFrame:
    """(line_id, text, confidence): words (line_id, pos, text, w, h) in order, and the mean of their confidences by length.

    With a column `row`, the line of the image that a word is in, line_id names an image: its lines are joined by line breaks.
    """
    conf = tx.word_confidence("text", "w", "h")
    n = F.length(tx.filled("text"))
    row = F.col("row") if "row" in words.columns else F.lit(0)
    per = words.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct(row.alias("row"), "pos", tx.filled("text").alias("text")))).alias("_w"), F.try_divide(F.sum(conf * n), F.sum(n)).alias("_mean"))
    before = lambda i: F.when(i == 0, "").when(F.get("_w", i - 1)["row"] == F.get("_w", i)["row"], " ").otherwise("\n")
    joined = per.select("line_id", F.array_join(F.transform("_w", lambda x, i: F.concat(before(i), x["text"])), "").alias("text"), F.coalesce("_mean", F.lit(0.0)).alias("_mean"))
    return joined.select("line_id", "text", tx.confidence_with_quality("text", "_mean").alias("confidence"))


def best_pass(attempts: DataFrame) -> DataFrame:
    """(video_id, ts_ms, mode, text, confidence) of the pass whose adjusted confidence is highest, the first of those.

    Attempts are (video_id, ts_ms, ord, mode, text, conf). Passes after the first that is good enough don't count. Fallbacks count only
    where no pass reads anything; the first that does is taken as it is. Without any the text is empty.
    """
    key = ["video_id", "ts_ms"]
    text = tx.filled("text")
    read, back = ~tx.is_blank(text), F.coalesce(F.col("mode").isin(*FALLBACKS), F.lit(False))
    some = attempts.select(*key, "ord", "mode", text.alias("text"), F.col("conf").cast("double").alias("conf"), F.when(read & ~back, adjusted("conf", text)).alias("adj"), (read & back).alias("spare"))
    enough = (F.col("adj") >= ENOUGH) & (F.length("text") >= LONG_ENOUGH)
    # a frame has a handful of attempts
    per = some.groupBy(*key).agg(F.collect_list(F.struct("ord", "mode", "text", "conf", "adj", "spare")).alias("t"), F.min(F.when(enough, F.col("ord"))).alias("last"))
    counts = F.filter("t", lambda x: x["adj"].isNotNull() & (F.col("last").isNull() | (x["ord"] <= F.col("last"))))
    best = F.array_max(F.transform(counts, lambda x: F.struct(x["adj"].alias("confidence"), (-x["ord"]).alias("o"), x["mode"].alias("mode"), x["text"].alias("text"))))
    spare = F.array_min(F.transform(F.filter("t", lambda x: x["spare"]), lambda x: F.struct(x["ord"].alias("o"), x["mode"].alias("mode"), x["text"].alias("text"), x["conf"].alias("confidence"))))
    out = per.select(*key, best.alias("b"), spare.alias("s"))
    return out.select(*key, *[F.coalesce(f"b.{c}", f"s.{c}", none).alias(c) for c, none in (("mode", F.lit(None)), ("text", F.lit("")), ("confidence", F.lit(0.0)))])


def empty_rate(ocr: DataFrame, most: float = 0.8) -> DataFrame:
    """(video_id, frames, empty, warned): whether nearly all frames of a video are without text."""
    rate = ocr.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(tx.is_blank("text")).alias("empty"))
    return rate.withColumn("warned", F.col("empty") > F.col("frames") * most)


def recognize(frames: DataFrame, engine: Engine, mode: str = "Auto", looked_at: str | None = None) -> DataFrame:
    """(video_id, ts_ms, text) of frames (video_id, ts_ms, and data, width, height of a BGR image), read with an engine.

    Mode Auto tries the passes in turn, up to one that is good enough, and keeps the best. A frame that can't be read gives an empty text. Frames are read one at a time
    where they lie, so an executor holds few images at once. looked_at, a folder that executors see, gets every frame and what each
    pass made of it, as PNG files.
    """
    from captionforge.sources.frames import save_image

    from .raster import preprocess as made
    from .raster import upscale

    def passes(pixels: np.ndarray, name: str) -> list[tuple[str, str, float]]:
        def preprocess(pixels: np.ndarray, m: str) -> np.ndarray:
            image = made(pixels, m)
            if looked_at:
                save_image(image, os.path.join(looked_at, f"1_{m}_{name}.png"))
            return image

        if looked_at:
            os.makedirs(looked_at, exist_ok=True)
            save_image(pixels, os.path.join(looked_at, f"0_original_{name}.png"))
        out = []
        for m in PASSES if mode == "Auto" else (mode,):
            try:
                text, conf = engine.recognize(preprocess(pixels, m))
            except (ValueError, ArithmeticError, OSError):
                continue
            if text and text.strip():
                out.append((m, text, float(conf)))
                if float(conf) * 0.7 + quality(text) * 30 >= ENOUGH and len(text) >= LONG_ENOUGH:
                    break
        if not out and mode == "Auto":
            for m in FALLBACKS:
                text, conf = engine.recognize(upscale(pixels) if m == "Raw" else preprocess(pixels, m))
                if text and text.strip():
                    return [(m, text, float(conf))]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                pixels = np.frombuffer(f.data, np.uint8).reshape(f.height, f.width, -1)[:, :, 2::-1]
                found = passes(pixels, f"{f.video_id}_{f.ts_ms}")
                rows += [(f.video_id, f.ts_ms, k, m, t, c) for k, (m, t, c) in enumerate(found)] or [(f.video_id, f.ts_ms, 0, mode, "", 0.0)]
            yield pd.DataFrame(rows, columns=["video_id", "ts_ms", "ord", "mode", "text", "conf"])

    read = frames.select("video_id", "ts_ms", "data", "width", "height").mapInPandas(run, "video_id long, ts_ms long, ord int, mode string, text string, conf double")
    best = best_pass(read)
    return best.select(*[F.col(c.split()[0]) for c in OCR.split(", ")]).withColumn("text", tx.normalize_ocr("text"))


def throughput(progress: DataFrame, total: str = "total") -> DataFrame:
    """progress (done frames, seconds elapsed, and the total) with percent, fps, left and said, where it is worth telling: every fiftieth part.

    A rate of nothing leaves the time as it would be at a thousandth of a frame a second. (Wording and limits are fixed.)
    """
    every = F.greatest(F.lit(1), F.expr(f"{total} div 50"))
    fps = F.col("done") / F.col("seconds")
    left = ((F.col(total) - F.col("done")) / (fps + 0.001)).cast("long")
    clock = F.format_string("%02d:%02d", F.expr("left_s div 60 % 60"), F.expr("left_s % 60"))
    shown = progress.filter(F.col("done") % every == 0).withColumns({"percent": (F.col("done") / F.col(total) * 100).cast("int"), "fps": fps, "left_s": left})
    said = F.format_string("OCR: %d/%d (%d%%) - %.1f fps - ETA: %s", "done", total, "percent", F.round("fps", 1), clock)
    return shown.withColumn("said", said)
