"""Cue times: shifting, overlaps, gaps, durations, issues, statistics, refinement against frames.

All but `adjust_gaps` read only the next cue's start, so they are one window over (video_id, start_ms, idx), and a chain of them keeps the
partitioning of its first. Columns besides those of a cue are kept.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Rows, fold

#: Least duration that a cut leaves, and duration a cut falls back to.
FLOOR = 100
#: Frames per second of a video that nothing is known of. (Fixed value.)
UNKNOWN_FPS = 4


def in_order():
    return Window.partitionBy("video_id").orderBy("start_ms", "idx")


def in_list():
    return Window.partitionBy("video_id").orderBy("idx")


def duration() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def with_end(df: DataFrame, end: Column) -> DataFrame:
    return df.withColumn("end_ms", end.cast("long"))


def with_next(df: DataFrame, end, window=None) -> DataFrame:
    """df with the end that end(next start) gives; the last cue of a video keeps its own."""
    following = df.withColumn("_next", F.lead("start_ms").over(window or in_order()))
    return with_end(following, F.when(F.col("_next").isNull(), F.col("end_ms")).otherwise(end(F.col("_next")))).drop("_next")


def shift_time(df: DataFrame, ms: int) -> DataFrame:
    """Both times moved; none before zero, and no cue shorter than 100 ms."""
    start = F.greatest(F.lit(0), F.col("start_ms") + ms).cast("long")
    return df.withColumns({"start_ms": start, "end_ms": F.greatest(start + FLOOR, F.col("end_ms") + ms).cast("long")})


def fix_overlap(df: DataFrame, min_gap: int = 0) -> DataFrame:
    """A cue that overlaps the next ends min_gap before it, or 100 ms after its own start if that is later."""
    cut = lambda n: F.when(n - min_gap <= F.col("start_ms"), F.col("start_ms") + FLOOR).otherwise(n - min_gap)
    return with_next(df, lambda n: F.when(F.col("end_ms") > n, cut(n)).otherwise(F.col("end_ms")))


def extend_duration(df: DataFrame, max_gap: int = 1000, max_extension: int = 3000) -> DataFrame:
    """A cue before a gap of more than max_gap lasts longer, until 50 ms before the next at most."""
    return with_next(df, lambda n: F.when(n - F.col("end_ms") > max_gap, F.least(F.col("end_ms") + max_extension, n - 50)).otherwise(F.col("end_ms")))


def min_duration(df: DataFrame, ms: int = 500) -> DataFrame:
    return with_end(df, F.greatest("end_ms", F.col("start_ms") + ms))


def max_duration(df: DataFrame, ms: int = 10_000) -> DataFrame:
    return with_end(df, F.least("end_ms", F.col("start_ms") + ms))


def auto_fix(df: DataFrame) -> DataFrame:
    """Durations of 300 ms to 10 s, no overlaps, 30 ms between cues, gaps of over 2 s filled by up to 3 s."""
    return df.transform(min_duration, 300).transform(max_duration, 10_000).transform(fix_overlap, 30).transform(extend_duration, 2000, 3000)


def adjust_gaps(df: DataFrame, gap: int = 100) -> DataFrame:
    """Exactly `gap` between cues: each ends so long before the next. Where that leaves a cue no time it lasts 100 ms, and the next starts later.

    A start that is moved counts for what follows, so this is a fold over a video's cues.
    """

    def run(rows: Rows) -> Rows:
        for last, cue in pairwise(rows):
            if cue["start_ms"] - last["end_ms"] != gap:
                if cue["start_ms"] <= last["start_ms"] + gap:
                    cue["start_ms"] = last["start_ms"] + FLOOR + gap
                last["end_ms"] = cue["start_ms"] - gap
        return rows

    return fold(df, run, ["start_ms", "idx"])


def time_issues(df: DataFrame) -> DataFrame:
    """(video_id, idx, issue_type, description): durations that are nothing, too short or too long, and overlaps with the next cue."""
    d = duration()
    following = df.withColumns({"_next": F.lead("start_ms").over(in_order()), "_idx": F.lead("idx").over(in_order())})
    issue = lambda test, kind, *says: F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.concat(*says).alias("description")))
    ms = F.concat(d.cast("string"), F.lit("ms"))
    found = F.array(
        issue(d <= 0, "InvalidDuration", F.lit("Duration <= 0: "), ms),
        issue(d < 200, "TooShort", F.lit("Duration quá ngắn: "), ms),
        issue(d > 15_000, "TooLong", F.lit("Duration quá dài: "), ms),
        issue(F.col("end_ms") > F.col("_next"), "Overlap", F.lit("Overlap với subtitle "), F.col("_idx").cast("string")),
    )
    return following.select("video_id", "idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("video_id", "idx", "i.issue_type", "i.description")


def truncated(x: Column) -> Column:
    return x.cast("long")


def time_statistics(df: DataFrame) -> DataFrame:
    """Per video: cues; average (truncated), least and greatest duration and gap; overlaps. Gaps are 0 where there is one cue."""
    gaps = df.withColumn("_gap", F.lead("start_ms").over(in_order()) - F.col("end_ms"))
    some = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return gaps.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"),
        truncated(F.avg(duration())).alias("avg_duration"),
        F.min(duration()).alias("min_duration"),
        F.max(duration()).alias("max_duration"),
        some(truncated(F.avg("_gap"))).alias("avg_gap"),
        some(F.min("_gap")).alias("min_gap"),
        some(F.max("_gap")).alias("max_gap"),
        F.count_if(F.col("_gap") < 0).alias("overlaps"),
    )


def refine_timing(df: DataFrame, frame_text: DataFrame, step: int = 100, bucket: int = 1200) -> DataFrame:
    """Starts and ends moved to where text shows and goes, by frames (video_id, ts_ms, has_text).

    The start is that of the first frame with text from 800 ms before to 400 ms after it; the end that of the first frame without
    from 400 ms before to 800 ms after. A window's frames are those on its own grid of `step` from its begin, as a cut of the video
    would have them. What isn't found stays. Windows and frames meet by (video, bucket of time): a window touches two at most.
    """
    begin = lambda c, before: F.greatest(F.lit(0), F.col(c) - before).cast("long")
    keyed = df.withColumn("_at", F.struct("idx", "start_ms"))
    starts = keyed.select("video_id", "_at", F.lit("start").alias("_side"), begin("start_ms", 800).alias("_from"), (F.col("start_ms") + 400).alias("_to"))
    ends = keyed.select("video_id", "_at", F.lit("end").alias("_side"), begin("end_ms", 400).alias("_from"), (F.col("end_ms") + 800).alias("_to"))
    windows = starts.unionByName(ends).withColumn("_bucket", F.explode(F.expr(f"sequence(_from div {bucket}, greatest(_from, _to) div {bucket})")))
    frames = frame_text.select("video_id", "ts_ms", "has_text", F.expr(f"ts_ms div {bucket}").alias("_bucket"))
    on_grid = (F.col("ts_ms") >= F.col("_from")) & (F.col("ts_ms") <= F.col("_to")) & ((F.col("ts_ms") - F.col("_from")) % step == 0)
    met = windows.join(frames, ["video_id", "_bucket"]).filter(on_grid & (F.col("has_text") == (F.col("_side") == "start")))
    first = met.groupBy("video_id", "_at").agg(F.min(F.when(F.col("_side") == "start", F.col("ts_ms"))).alias("_start"), F.min(F.when(F.col("_side") == "end", F.col("ts_ms"))).alias("_end"))
    out = keyed.join(first, ["video_id", "_at"], "left")
    return out.withColumns({"start_ms": F.coalesce("_start", "start_ms"), "end_ms": F.coalesce("_end", "end_ms")}).select(*df.columns)


def optimal_fps(frame_text: DataFrame, sample: int = 100, videos: DataFrame | None = None) -> DataFrame:
    """(video_id, changes, fps): frames per second by how often text comes and goes in a video's middle frames.

    Of videos (video_id), if given, those without frames get UNKNOWN_FPS, with changes null.
    """
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    whole = Window.partitionBy("video_id")
    numbered = frame_text.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(whole)})
    numbered = numbered.withColumn("_first", F.expr(f"greatest(0, _n div 2 - least(_n, {sample}) div 2)"))
    middle = numbered.filter((F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_first") + F.least(F.col("_n"), F.lit(sample))))
    flips = middle.withColumn("_flip", F.col("has_text") != F.lag("has_text", 1, False).over(order))
    counted = flips.groupBy("video_id").agg(F.count_if("_flip").alias("changes"))
    found = counted.withColumn("fps", F.when(F.col("changes") > 25, 6).when(F.col("changes") > 15, 4).otherwise(2))
    if videos is None:
        return found
    every = videos.select("video_id").distinct().join(found, "video_id", "left")
    return every.withColumn("fps", F.coalesce("fps", F.lit(UNKNOWN_FPS)))
