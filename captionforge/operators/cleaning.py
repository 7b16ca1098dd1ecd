"""Cue cleaning: texts, short and long cues, cues that are noise, overlaps, numbering, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionforge.functions import text as tx

from .folds import merge
from .timing import FLOOR, duration, in_list, in_order, truncated, with_next


def with_text(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("text", text)


def clean_ocr_text(df: DataFrame) -> DataFrame:
    return with_text(df, tx.clean_ocr_text("text"))


def remove_duplicate_lines(df: DataFrame) -> DataFrame:
    return with_text(df, tx.remove_duplicate_lines("text"))


def merge_short(df: DataFrame, min_duration: int = 150, max_gap: int = 500) -> DataFrame:
    """A cue shorter than min_duration takes in those that follow within max_gap, line by line, until it is long enough.

    Cues are taken in list order. Every cue goes through the fold, which is one pass over a video's cues.
    """

    def joins(last: dict, cue: dict) -> bool:
        return last["end_ms"] - last["start_ms"] < min_duration and cue["start_ms"] - last["end_ms"] < max_gap

    def joined(last: dict, cue: dict) -> dict:
        return last | {"text": last["text"].removesuffix("\n") + "\n" + cue["text"], "end_ms": cue["end_ms"]}

    return merge(df, (joins, joined), order=["idx"])


def split_long(df: DataFrame, max_lines: int = 2) -> DataFrame:
    """A cue of more than max_lines lines becomes several; each line gets an equal part of the time."""
    lines = tx.lines_of("text")
    n = F.size(lines)
    each = F.expr("(end_ms - start_ms) div size(_lines)")
    parts = df.withColumn("_lines", lines).withColumn("_part", F.explode(F.when(n > max_lines, F.expr(f"sequence(0, size(_lines) - 1, {max_lines})")).otherwise(F.array(F.lit(-1)))))
    split = F.col("_part") >= 0
    chunk = F.slice("_lines", F.col("_part") + 1, F.lit(max_lines))
    return parts.withColumns(
        {
            "text": F.when(split, F.array_join(chunk, "\n")).otherwise(F.col("text")),
            "end_ms": F.when(split, F.least(F.col("start_ms") + (F.col("_part") + F.size(chunk)) * each, F.col("end_ms"))).otherwise(F.col("end_ms")).cast("long"),
            "start_ms": F.when(split, F.col("start_ms") + F.col("_part") * each).otherwise(F.col("start_ms")).cast("long"),
        }
    ).drop("_lines", "_part")


def is_valid() -> Column:
    """Whether a cue is text at all, and long enough to be read."""
    text = tx.filled("text")
    short, one_cjk = F.length(tx.trimmed(text)) < 2, tx.trimmed(text).rlike(f"^[{tx.CJK}]$")
    enough = tx.alnum_count(text) >= F.when(tx.has_cjk(text), 1).otherwise(2)
    full = enough & ~tx.one_char_repeated(tx.without_spaces(text))
    return ~tx.is_blank(text) & (duration() >= 80) & F.when(short, one_cjk).otherwise(full)


def remove_invalid(df: DataFrame) -> DataFrame:
    return df.filter(is_valid())


def fix_overlapping_times(df: DataFrame, gap: int = 30) -> DataFrame:
    """A cue that overlaps the next in the list ends `gap` before it; none ends within 100 ms of its start."""
    cut = lambda n: F.when(n - gap - F.col("start_ms") < FLOOR, F.col("start_ms") + FLOOR).otherwise(n - gap)
    return with_next(df, lambda n: F.when(F.col("end_ms") > n, cut(n)).otherwise(F.col("end_ms")), in_list())


def reindex(df: DataFrame, by_list: bool = False) -> DataFrame:
    """idx from 1, by start or in the order of the list."""
    return df.withColumn("idx", F.row_number().over(in_list() if by_list else in_order()))


def clean_subtitles(df: DataFrame) -> DataFrame:
    """Texts cleaned, short cues joined, long ones split, noise removed, overlaps cut, numbered anew."""
    steps = [clean_ocr_text, remove_duplicate_lines, merge_short, split_long]
    for step in steps:
        df = df.transform(step)
    # parts of a split cue stand in the list where it stood
    numbered = df.withColumn("idx", F.row_number().over(in_list().orderBy("idx", "start_ms")))
    return numbered.transform(remove_invalid).transform(fix_overlapping_times).transform(reindex, True)


def count_valid(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(F.count_if(~tx.is_blank("text")).alias("valid"))


def statistics(df: DataFrame) -> DataFrame:
    """Per video: cues, sum, average (truncated), least and greatest duration, average lines of a text."""
    d = duration()
    return df.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(d).alias("total_duration"),
        truncated(F.avg(d)).alias("avg_duration"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.avg(F.size(F.split(tx.filled("text"), "\n"))).alias("avg_lines"),
    )


def statistics_text(stats: DataFrame) -> DataFrame:
    """(video_id, text): statistics as they are shown. (The wording is fixed.)"""
    said = F.format_string("Total: %d | Avg: %dms | Min: %dms | Max: %dms | Avg Lines: %.1f", "total", "avg_duration", "min_duration", "max_duration", "avg_lines")
    return stats.select("video_id", said.alias("text"))


def grid(df: DataFrame) -> DataFrame:
    """Cues as a table shows them."""
    from captionforge.sources.srt import srt_time

    return df.select("video_id", "idx", srt_time("start_ms").alias("start"), srt_time("end_ms").alias("end"), F.concat(duration().cast("string"), F.lit("ms")).alias("duration"), F.replace(tx.filled("text"), F.lit("\n"), F.lit(" | ")).alias("text"))


def validate(df: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, idx, error): blank texts, times that can't be, overlaps with the next cue of the list.

    Of videos (video_id), if given, those without any cue have an error of their own, with idx null.
    """
    following = df.withColumns({"_next": F.lead("start_ms").over(in_list()), "_idx": F.lead("idx").over(in_list())})
    name = F.concat(F.lit("Subtitle "), F.col("idx").cast("string"))
    error = lambda test, *says: F.when(test, F.concat(name, *says))
    found = F.array(
        error(tx.is_blank("text"), F.lit(": Text trống")),
        error(F.col("start_ms") < 0, F.lit(": StartTime < 0")),
        error(F.col("end_ms") <= F.col("start_ms"), F.lit(": EndTime <= StartTime")),
        error(F.col("end_ms") > F.col("_next"), F.lit(": Overlap với subtitle "), F.col("_idx").cast("string")),
    )
    errors = following.select("video_id", "idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))
    if videos is None:
        return errors
    without = videos.select("video_id").distinct().join(df.select("video_id").distinct(), "video_id", "left_anti")
    return errors.unionByName(without.select("video_id", F.lit(None).cast(df.schema["idx"].dataType).alias("idx"), F.lit("Không có subtitle").alias("error")))
