"""Videos and frames: which files are videos, when a frame is, what ffmpeg says, the frames of a folder."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.functions import text as tx

#: Extensions of videos. (Fixed values.)
VIDEOS = ("mp4", "mkv", "avi", "mov", "wmv")
#: Videos whose first frame's number is broadcast at most: some ten bytes each.
VIDEOS_AT_ONCE = 1_000_000


def is_video(path: Column | str) -> Column:
    return F.lower(tx.filled(path)).rlike(rf"\.({'|'.join(VIDEOS)})$")


def find_ffmpeg(home: str = ".") -> str | None:
    """The program in the folder, in its ffmpeg/bin or bin, or on the path."""
    for folder in ("", "ffmpeg/bin", "bin"):
        if found := shutil.which("ffmpeg", path=os.path.join(home, folder)):
            return found
    return shutil.which("ffmpeg")


def checked_fps(fps: int) -> int:
    if not 1 <= fps <= 10:
        raise ValueError(f"frames per second are 1 to 10, not {fps}")
    return fps


def frame_time(number: Column | str, fps: int) -> Column:
    """Milliseconds of the frame of a number from 0, truncated."""
    return (tx.col(number) * 1000.0 / float(fps)).cast("long")


def frame_manifest(files: DataFrame, fps: int = 2, begin: Column | int = 0, zero_based: bool = False) -> DataFrame:
    """(video_id, frame_no, path, ts_ms) of frames (video_id, path), numbered by file name.

    zero_based: frames of a stretch of a video that starts at `begin`, whose numbers start at 0.
    """
    k = F.row_number().over(Window.partitionBy("video_id").orderBy("path")) - 1
    start = F.lit(begin) if isinstance(begin, int) else begin
    numbered = files.withColumn("_k", k)
    return numbered.select("video_id", (F.col("_k") + (0 if zero_based else 1)).cast("int").alias("frame_no"), "path", (start + frame_time("_k", checked_fps(fps))).cast("long").alias("ts_ms"))


def read_frames(spark: SparkSession, folder: str, fps: int = 2, pattern: str = r"frame_\d+\.png$") -> DataFrame:
    """(video_id, frame_no, path, ts_ms, data, width, height) of a folder of videos' folders of frames; video_id is a hash of the folder.

    Frames are numbered by name from a listing that opens no file. Where a video's names count without a gap, which is the rule, its
    first number is all that its images need, and they stay where they are read; the images of other videos are joined by path.
    """
    # the two readers don't write a local path alike
    plain_path = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("path")
    of = F.xxhash64(F.regexp_replace("path", "/[^/]*$", ""))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(plain_path("path")).filter(F.col("path").rlike(pattern)).withColumn("video_id", of)
    number = F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("long")
    per = listed.groupBy("video_id").agg(F.min(number).alias("_first"), (F.max(number) - F.min(number) + 1 == F.count(F.lit(1))).alias("_plain"))
    images = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select(plain_path("image.origin"), "image.data", "image.width", "image.height").filter(F.col("path").rlike(pattern)).withColumn("video_id", of)
    columns = ["video_id", "frame_no", "path", "ts_ms", "data", "width", "height"]
    small = per.limit(VIDEOS_AT_ONCE + 1).count() <= VIDEOS_AT_ONCE
    met = images.join(F.broadcast(per) if small else per, "video_id")
    plain = met.filter("_plain").withColumn("_k", number - F.col("_first"))
    plain = plain.withColumns({"frame_no": (F.col("_k") + 1).cast("int"), "ts_ms": frame_time("_k", checked_fps(fps))})
    if not per.filter("not _plain").limit(1).count():
        return plain.select(*columns)
    numbers = frame_manifest(listed.join(per.filter("not _plain"), "video_id", "left_semi"), fps)
    return plain.select(*columns).unionByName(met.filter("not _plain").drop("video_id").join(numbers, "path").select(*columns))


def stretch(start_ms: Column | str, end_ms: Column | str, fps: int = 10) -> Column:
    """The times of frames from start to end."""
    return F.sequence(tx.col(start_ms).cast("long"), tx.col(end_ms).cast("long"), F.lit(1000 // checked_fps(fps)).cast("long"))


def seconds_in(text: Column | str, label: str) -> Column:
    """Seconds of h:m:s.f after a label in what ffmpeg says, null if it doesn't say."""
    pattern = rf"{label}(\d+):(\d+):(\d+\.\d+)"
    part = lambda k: F.regexp_extract(tx.filled(text), pattern, k)
    return part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")


def video_duration(text: Column | str) -> Column:
    """Seconds, 0 where they aren't told."""
    return F.coalesce(seconds_in(text, r"Duration: "), F.lit(0.0))


def progress(text: Column | str, duration: Column | str) -> Column:
    """Percent of a video that is done, 100 at most; null where nothing is told."""
    total = tx.col(duration)
    done = seconds_in(text, "time=") / F.when(total > 0, total) * 100
    return F.when(done.isNotNull(), F.least(F.lit(100), done.cast("int")))


def frame_at(hours: Column, minutes: Column, seconds: Column, fps: int) -> Column:
    """The number of the frame at a time."""
    return ((hours * 3600 + minutes * 60 + seconds) * float(fps)).cast("int")


def time_at(frame: Column | str, fps: int) -> Column:
    """hh:mm:ss of a frame."""
    s = F.floor(tx.col(frame) / float(fps))
    part = lambda unit, n: F.lpad((F.floor(s / unit) % n).cast("string"), 2, "0")
    return F.concat(part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60))


def save_image(pixels, path: str) -> None:
    """A PNG of an RGB or grey array, for looking at passes."""
    import struct
    import zlib

    import numpy as np

    a = np.ascontiguousarray(pixels, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in a)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
