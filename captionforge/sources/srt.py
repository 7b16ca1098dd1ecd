"""SRT: reading and writing files, times, and what is known of a file."""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.functions import text as tx

BOM = b"\xef\xbb\xbf"
NUMBER = re.compile(r"[+-]?\d{1,9}")


def srt_time(ms: Column | str) -> Column:
    """hh:mm:ss,fff"""
    m = tx.col(ms).cast("long")
    part = lambda unit, n, wide: F.lpad((F.floor(m / unit) % n).cast("string"), wide, "0")
    hours = F.floor(m / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), part(1, 1000, 3))


def parse_time(text: Column | str) -> Column:
    """Milliseconds of h:m:s,f, 0 for what isn't that. The fraction counts as it stands: ,5 is 5 ms."""
    parts = F.split(F.replace(tx.filled(text), F.lit(","), F.lit(".")), ":")
    seconds = F.split(F.get(parts, F.lit(2)), r"\.")
    whole = lambda c: tx.trimmed(c).try_cast("int").cast("long")
    fraction = F.when(F.size(seconds) > 1, whole(F.get(seconds, F.lit(1)))).otherwise(F.lit(0))
    total = whole(F.get(parts, F.lit(0))) * 3_600_000 + whole(F.get(parts, F.lit(1))) * 60_000 + whole(F.get(seconds, F.lit(0))) * 1000 + fraction
    return F.when(F.size(parts) == 3, F.coalesce(total, F.lit(0))).otherwise(F.lit(0)).cast("long")


def entry(idx: Column | str = "idx", start: Column | str = "start_ms", end: Column | str = "end_ms", text: Column | str = "text") -> Column:
    """A cue as SRT: number, times, text, a line end after each."""
    return F.concat(tx.col(idx).cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), tx.filled(text), F.lit("\n"))


def srt_strings(subtitles: DataFrame) -> DataFrame:
    """(video_id, content): a video's cues by start, an empty line between. Numbers stay as they are."""
    cue = F.struct(F.col("start_ms"), F.col("idx"), entry().alias("e"))
    per = subtitles.groupBy("video_id").agg(F.array_sort(F.collect_list(cue)).alias("c"))
    return per.select("video_id", F.concat(F.array_join(F.transform("c", lambda x: x["e"]), "\n"), F.lit("\n")).alias("content"))


def export_srt(subtitles: DataFrame, path: str) -> None:
    """One cue list as a UTF-8 file with a byte order mark; a list without cues is an error."""
    rows = srt_strings(subtitles.withColumn("video_id", F.lit(0))).first()
    if rows is None:
        raise ValueError("there is no subtitle to export")
    with open(path, "wb") as f:
        f.write(BOM + rows["content"].encode())


def export_all(subtitles: DataFrame, path: str) -> None:
    """Every video's SRT as a row of text, in a folder by video: written by the executors."""
    srt_strings(subtitles).write.partitionBy("video_id").mode("overwrite").text(path)


def parse_ms(text: str) -> int:
    parts = text.replace(",", ".").split(":")
    try:
        h, m, (s, *f) = int(parts[0]), int(parts[1]), parts[2].split(".")
        return h * 3_600_000 + m * 60_000 + int(s) * 1000 + (int(f[0]) if f else 0) if len(parts) == 3 else 0
    except (ValueError, IndexError):
        return 0


def parse_srt(content: str, strict_reference: bool = False) -> list[tuple[int, int, int, str]]:
    """(number, start, end, text) of the cues of a file, in its order.

    A number begins a cue where a time follows it; anywhere else it is text. With strict_reference every number begins one, and a line
    with an arrow is never text: a number inside a text then takes the lines before it along and loses their times.
    """
    out: list[tuple[int, int, int, str]] = []
    lines = [x.strip() for x in content.lstrip("\ufeff").splitlines()]
    cue: list[int] | None = None
    text: list[str] = []

    def close() -> None:
        nonlocal cue
        if cue is not None and text:
            out.append((cue[0], cue[1], cue[2], "\n".join(text)))
            text.clear()
            cue = None

    timed = False
    for k, line in enumerate(lines):
        if not line:
            close()
            continue
        arrow = "-->" in line
        if NUMBER.fullmatch(line) and (strict_reference or (k + 1 < len(lines) and "-->" in lines[k + 1])):
            if not strict_reference:
                close()
                text.clear()
            cue, timed = [int(line), 0, 0], False
        elif arrow and (strict_reference or not timed):
            parts = line.split("-->")
            if len(parts) == 2 and cue is not None:
                cue[1:], timed = [parse_ms(p.strip()) for p in parts], True
        elif cue is not None:
            text.append(line)
    close()
    return out


def import_srt(spark: SparkSession, paths: str | list[str], strict_reference: bool = False) -> DataFrame:
    """(path, idx, start_ms, end_ms, text) of the cues of SRT files, a file at a time on the executors."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse_files(files, strict_reference)


def parse_files(files: DataFrame, strict_reference: bool = False) -> DataFrame:
    """import_srt over files that are rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f.path, *cue) for f in batch.itertuples() for cue in parse_srt(f.content or "", strict_reference)]
            yield pd.DataFrame(rows, columns=["path", "idx", "start_ms", "end_ms", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, idx int, start_ms long, end_ms long, text string")


def clock(ms: Column | str) -> Column:
    """hh:mm:ss, days left out."""
    m = tx.col(ms)
    part = lambda unit, n: F.lpad((F.floor(m / unit) % n).cast("string"), 2, "0")
    return F.concat(part(3_600_000, 24), F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60))


def size_text(size: Column | str) -> Column:
    n = tx.col(size)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.2f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", n / (1024.0 * 1024.0)), F.lit(" MB")))


def encoding_name(head: Column) -> Column:
    """By the byte order mark at the begin of a file; without one it is UTF-8."""
    h = F.hex(head)
    return F.when(h.startswith("FFFE0000"), "Unicode (UTF-32)").when(h.startswith("FFFE"), "Unicode").when(h.startswith("FEFF"), "Unicode (Big-Endian)").otherwise("Unicode (UTF-8)")


def file_info(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, subtitles, duration_ms, size, encoding, duration, size_text) of SRT files."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), encoding_name(F.substring("content", 1, 4)).alias("encoding"))
    cues = import_srt(spark, paths).groupBy("path").agg(F.count(F.lit(1)).alias("subtitles"), F.max("end_ms").alias("duration_ms"))
    met = files.join(cues, F.regexp_replace(files["path"], "^file:/+", "/") == F.regexp_replace(cues["path"], "^file:/+", "/"), "left").drop(cues["path"])
    found = met.withColumns({"subtitles": F.coalesce("subtitles", F.lit(0)), "duration_ms": F.coalesce("duration_ms", F.lit(0))})
    return found.select("path", "subtitles", "duration_ms", "size", "encoding", clock("duration_ms").alias("duration"), size_text("size").alias("size_text"))


def backup_file(path: str) -> str:
    """Copies a file to the first of .bak, .bak1, .bak2, ... that isn't there."""
    target, k = path + ".bak", 0
    while os.path.exists(target):
        k += 1
        target = f"{path}.bak{k}"
    shutil.copyfile(path, target)
    return target
