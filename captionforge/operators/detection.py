"""Subtitle detection: frame texts to spans, spans merged, noise removed, the timeline put in order.

Runs of frames with the same text are collapsed in the JVM first (`runs`), so that what reaches the fold is one row for each reading and
not for each frame; the fold's result is the same, since within a run only the last time changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionforge.functions import text as tx
from captionforge.schema import SUBTITLES, DetectorConfig

from .folds import Rows, Rule, fold, is_better, merge, merging, score_text, similarity
from .timing import in_order


def interval(fps: int) -> int:
    return 1000 // max(1, fps)


def threshold(fps: int, base: float) -> float:
    return base + (0.03 if fps <= 2 else {3: -0.02, 4: -0.05, 5: -0.08}.get(fps, -0.10))


def most_empty(fps: int) -> int:
    """Empty frames that end a span."""
    return 4 if fps <= 2 else max(4, fps)


def runs(ocr: DataFrame, fps: int = 4, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """(video_id, first_ms, last_ms, n, text): neighbouring frames with one cleaned text; texts too short to count are empty.

    A gap that would end a span ends a run as well.
    """
    gap = max(config.max_gap, 4 * interval(fps))
    text = tx.clean_text("text")
    cleaned = ocr.select("video_id", "ts_ms", F.when(F.length(text) >= config.min_length, text).otherwise("").alias("text"))
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    new = (F.lag("text").over(order) != F.col("text")) | (F.col("ts_ms") - F.lag("ts_ms").over(order) > gap)
    numbered = cleaned.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    grouped = numbered.groupBy("video_id", "_run").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    return grouped.drop("_run")


class Folder:
    """The fold over a video's runs in order of time. What it holds between two runs is `state`, so it can stop and go on."""

    def __init__(self, fps: int, config: DetectorConfig, state: tuple | None = None):
        self.interval, self.gap = interval(fps), max(config.max_gap, 4 * interval(fps))
        self.near, self.most, self.config = threshold(fps, config.similarity), most_empty(fps), config
        #: text held, best reading, start, last time seen, empty frames, spans so far
        self.held, self.best, self.start, self.last, self.empty, self.count = state or (None, None, 0, 0, 0, 0)

    @property
    def state(self) -> tuple:
        return self.held, self.best, self.start, self.last, self.empty, self.count

    def close(self, shortest: int, floor: int) -> Rows:
        """The span that is open, if it is long enough; nothing is open after that."""
        text, brief = self.best, self.last - self.start < self.config.min_duration or len(self.best) < self.config.min_length
        self.held = self.best = None
        if brief and len(text) < shortest:
            return []
        self.count += 1
        end = max(self.last + self.interval, self.start + floor) if brief else self.last + self.interval // 2
        return [{"idx": self.count, "start_ms": self.start, "end_ms": end, "text": text}]

    def feed(self, row: dict) -> Rows:
        """Spans that a run brings to an end."""
        out: Rows = []
        text, first = row["text"], row["first_ms"]
        if not text:
            self.empty += row["n"]
            return self.close(3, 0) if self.held is not None and self.empty >= self.most else out
        self.empty = 0
        if self.held is not None:
            alike = max(similarity(self.held, text), similarity(self.best, text) if self.best != self.held else 0.0)
            if alike >= self.near and first - self.last <= self.gap:
                self.best = max(self.best, text, key=score_text)
                self.held = text if is_better(text, self.held) else self.held
                self.last = row["last_ms"]
                return out
            out = self.close(3, 500)
        self.held = self.best = text
        self.start, self.last = first, row["last_ms"]
        return out

    def finish(self) -> Rows:
        return self.close(2, 500) if self.held is not None else []


def spans_of(rows: Rows, fps: int, config: DetectorConfig) -> Rows:
    """Spans of a video's runs before any merging."""
    folder = Folder(fps, config)
    return [span for row in rows for span in folder.feed(row)] + folder.finish()


def raw_spans(ocr: DataFrame, fps: int = 4, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Spans as the fold leaves them."""

    def run(rows: Rows) -> Rows:
        return [r | {"video_id": rows[0]["video_id"]} for r in spans_of(rows, fps, config)]

    return fold(runs(ocr, fps, config), run, ["first_ms"], SUBTITLES)


def better_text(last: dict, cue: dict) -> str:
    return cue["text"] if is_better(cue["text"], last["text"]) else last["text"]


def similar(least: float, low: int, high: int, furthest: bool) -> Rule:
    """Cues join the last if they are similar and the gap between is from low to below high; the end is the later's, or the furthest."""

    def joins(last: dict, cue: dict) -> bool:
        return low <= cue["start_ms"] - last["end_ms"] < high and similarity(cue["text"], last["text"]) >= least

    def joined(last: dict, cue: dict) -> dict:
        return last | {"end_ms": max(last["end_ms"], cue["end_ms"]) if furthest else cue["end_ms"], "text": better_text(last, cue)}

    return joins, joined


def near_duplicates(fps: int) -> Rule:
    return similar(0.75, -(1 << 62), max(1500, 5 * interval(fps)), True)


def gapped(fps: int) -> Rule:
    return similar(0.85, 0, max(2000, 6 * interval(fps)), False)


def adjacent() -> Rule:
    return similar(0.92, -500, 3000, True)


def continuations(max_gap: int = 1500) -> Rule:
    """A cue that breaks off with dots or a dash goes on with the next."""

    def joins(last: dict, cue: dict) -> bool:
        return cue["start_ms"] - last["end_ms"] < max_gap and last["text"].endswith(("..", "-"))

    def joined(last: dict, cue: dict) -> dict:
        return last | {"text": last["text"].rstrip(".- ") + " " + cue["text"], "end_ms": cue["end_ms"]}

    return joins, joined


def merge_near_duplicates(df: DataFrame, fps: int = 4) -> DataFrame:
    return merge(df, near_duplicates(fps))


def merge_gapped(df: DataFrame, fps: int = 4) -> DataFrame:
    return merge(df, gapped(fps))


def merge_adjacent(df: DataFrame) -> DataFrame:
    return merge(df, adjacent())


def merge_continuations(df: DataFrame, max_gap: int = 1500) -> DataFrame:
    return merge(df, continuations(max_gap))


def is_no_noise(min_length: int = 2) -> Column:
    text = tx.filled("text")
    ratio = tx.alnum_ratio(text) >= F.when(tx.has_cjk(text), 0.15).otherwise(0.20)
    brief = (F.col("end_ms") - F.col("start_ms") < 80) & (F.length(text) < 3)
    return (F.length(text) >= min_length) & ratio & ~brief & ~tx.one_char_repeated(F.replace(text, F.lit(" "), F.lit("")))


def filter_noise(df: DataFrame, min_length: int = 2) -> DataFrame:
    return df.filter(is_no_noise(min_length))


def fix_timeline(df: DataFrame, fps: int = 4) -> DataFrame:
    """Least durations; of an overlap with the next cue half goes, or all where half would leave too little. Numbered anew by start.

    (Half of an overlap stays: that is what the rule comes to, and results depend on it.)
    """
    least = max(200, interval(fps))
    order = df.withColumns({"_next": F.lead("start_ms").over(in_order()), "_no": F.row_number().over(in_order())})
    end = F.greatest(F.col("end_ms"), F.col("start_ms") + least)
    grown = order.withColumn("end_ms", end)
    middle = F.expr("(end_ms + _next) div 2")
    cut = F.when(middle - F.col("start_ms") >= least, middle - 10).otherwise(F.col("_next") - 10)
    cut = F.when(cut <= F.col("start_ms"), F.col("start_ms") + least).otherwise(cut)
    fixed = grown.withColumn("end_ms", F.when(F.col("end_ms") > F.col("_next"), cut).otherwise(F.col("end_ms")).cast("long"))
    return fixed.withColumn("idx", F.col("_no")).drop("_next", "_no")


def detect_subtitles(ocr: DataFrame, fps: int = 4, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Cues of every video from its frames' texts (video_id, ts_ms, text). A frame that wasn't read has no row; one without text an empty one."""
    rules = [near_duplicates(fps), continuations(), gapped(fps), adjacent()]

    # spans come in order of start, and merging keeps it: one pass per video for all
    def run(rows: Rows) -> Rows:
        spans = [r | {"video_id": rows[0]["video_id"]} for r in spans_of(rows, fps, config)]
        for rule in rules:
            spans = merging(rule)(spans)
        return spans

    spans = fold(runs(ocr, fps, config), run, ["first_ms"], SUBTITLES)
    return spans.transform(filter_noise, config.min_length).transform(fix_timeline, fps)
