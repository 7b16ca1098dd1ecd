"""Spans from a stream of frame texts: the detection's fold, with its state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from captionforge.functions import text as tx
from captionforge.operators.detection import Folder
from captionforge.schema import SUBTITLES, DetectorConfig

STATE = "held string, best string, start long, last long, empty long, count long, seen long"
COLUMNS = [c.split()[0] for c in SUBTITLES.split(", ")]


def stream_spans(frames: DataFrame, fps: int = 4, config: DetectorConfig = DetectorConfig(), late: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """Spans (before merging) of a stream of frames (video_id, ts_ms, text, seen_at timestamp), as they end.

    A video's frames are put in order within each batch; one older than a frame that was taken already is dropped. A video from which
    nothing has come for idle_ms, by the watermark, is over: what is open then ends, and its state goes.
    """
    text = tx.clean_text("text")
    cleaned = frames.withWatermark("seen_at", late).select("video_id", "ts_ms", "seen_at", F.when(F.length(text) >= config.min_length, text).otherwise("").alias("text"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, seen = state.get if state.exists else (None, None, 0, 0, 0, 0, -1)
        folder = Folder(fps, config, tuple(held))
        if state.hasTimedOut:
            spans = folder.finish()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
            spans = []
            for ts, text in zip(rows["ts_ms"].tolist(), rows["text"].tolist(), strict=True):
                if ts > seen:
                    spans += folder.feed({"text": text, "first_ms": ts, "last_ms": ts, "n": 1})
                    seen = ts
            state.update((*folder.state, seen))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["seen_at"].max().timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame([s | {"video_id": key[0]} for s in spans], columns=COLUMNS)

    return cleaned.groupBy("video_id").applyInPandasWithState(run, SUBTITLES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
