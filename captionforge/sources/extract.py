"""Frames cut from videos by an ffmpeg program, where the executors are."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from glob import glob

import pandas as pd
from pyspark.sql import DataFrame

from captionforge.schema import FRAMES

from .frames import checked_fps, find_ffmpeg

#: Names of a whole video's frames, numbered from 1, and of those of a stretch, numbered from 0. (Fixed values.)
WHOLE, STRETCH = "frame_%06d.png", "refine_%03d.png"
#: Lines of what the program says that an error repeats.
SAID = 5


def clock(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def command(program: str, video: str, folder: str, fps: int, start_ms: int | None = None, end_ms: int | None = None) -> list[str]:
    """The command line for a whole video, or for a stretch of it (the times stand before the input, so it is sought and not read)."""
    times = [] if start_ms is None else ["-ss", clock(start_ms), "-to", clock(end_ms)]
    return [program, *times, "-i", video, "-vf", f"fps={checked_fps(fps)}", os.path.join(folder, WHOLE if start_ms is None else STRETCH)]


def frames_of(video: str, folder: str, fps: int, program: str, start_ms: int | None = None, end_ms: int | None = None) -> list[tuple[int, str, int]]:
    """(number, path, ms) of the frames cut into folder, from which a whole video's earlier frames are cleared first.

    A video that isn't there, or that the program fails on, raises with what the program said last.
    """
    if not os.path.exists(video):
        raise FileNotFoundError(video)
    os.makedirs(folder, exist_ok=True)
    whole = start_ms is None
    if whole:
        for old in glob(os.path.join(glob_safe(folder), "frame_*.png")):
            os.remove(old)
    done = subprocess.run(command(program, video, folder, fps, start_ms, end_ms), stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True, errors="replace")
    if whole and done.returncode:
        raise RuntimeError("ffmpeg: " + "\n".join(done.stderr.splitlines()[-SAID:]))
    files = sorted(glob(os.path.join(glob_safe(folder), "frame_*.png" if whole else "refine_*.png")))
    return [(k + whole, path, int((start_ms or 0) + int(k * (1000.0 / fps)))) for k, path in enumerate(files)]


def glob_safe(folder: str) -> str:
    from glob import escape

    return escape(folder)


def extract_frames(videos: DataFrame, folder: str, fps: int = 2, program: str | None = None) -> DataFrame:
    """(video_id, frame_no, path, ts_ms) of videos (video_id, path and, for a stretch, start_ms and end_ms), cut when the result is computed.

    Frames go to <folder>/<video_id>, so folder must be one that all executors see. One video is one call of the program; deal videos
    out with repartition if they are few. A task that is tried again clears what it had cut.
    """
    checked_fps(fps)
    stretches = "start_ms" in videos.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = program or find_ffmpeg()
        if not found:
            raise FileNotFoundError("there is no ffmpeg program")
        for batch in batches:
            for v in batch.itertuples():
                times = (int(v.start_ms), int(v.end_ms)) if stretches else (None, None)
                rows = frames_of(v.path, os.path.join(folder, str(v.video_id)), fps, found, *times)
                yield pd.DataFrame([(v.video_id, *r) for r in rows], columns=["video_id", "frame_no", "path", "ts_ms"])

    return videos.select("video_id", "path", *(["start_ms", "end_ms"] if stretches else [])).mapInPandas(run, FRAMES)
