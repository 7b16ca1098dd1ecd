"""Named queries over the carrier views, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionforge.functions import text as tx
from captionforge.operators import cleaning, detection, ocr, pixels, regions, timing
from captionforge.sources import frames, srt

from . import carriers, fold_sql, prompt
from .carriers import ATTEMPTS_SQL, FRAMES_SQL, PIXELS_SQL, SUBS_SQL, WORDS_SQL
from .fold_sql import ALNUM, CJK, FIX, SPECIAL

Query = Callable[[SparkSession, str], DataFrame]
#: Made when a query is run: columns need a session, the catalogue does not.
Columns = Callable[[], dict[str, Column]]
WIDTH, HEIGHT = 1280, 720
#: Whole rows of every carrier image.
IMAGE = (20, 27)


def on_subs(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: operator(carriers.subs(spark, sf_dir), *args)


def on_frames(columns: Columns) -> Query:
    """Columns computed from each frame's text."""
    return lambda spark, sf_dir: carriers.frames(spark, sf_dir).select("video_id", "ts_ms", *[c.alias(n) for n, c in columns().items()])


def on_lines(columns: Columns) -> Query:
    return lambda spark, sf_dir: carriers.lines(spark, sf_dir).select("line_id", *[c.alias(n) for n, c in columns().items()])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the text before, and both as they are compared; a text is normalised once."""
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    frames = carriers.frames(spark, sf_dir).withColumn("norm", tx.normalize_for_comparison("text"))
    return frames.withColumns({"prev": F.lag("text").over(order), "prev_norm": F.lag("norm").over(order)}).filter("prev is not null")


def on_pairs(columns: Columns) -> Query:
    return lambda spark, sf_dir: pairs(spark, sf_dir).select("video_id", "ts_ms", *[c.alias(n) for n, c in columns().items()])


def on_gray(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: operator(pixels.with_gray(carriers.pixels(spark, sf_dir)), *args)


def scored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.scored_candidates(pixels.with_gray(carriers.pixels(spark, sf_dir)), *IMAGE)


def region_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.best_region(scored_regions(spark, sf_dir), ["img_id"])


def region_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = region_argmax(spark, sf_dir).withColumn("video_id", F.col("img_id") % 7)
    return regions.region_of_frames(best, "video_id", "img_id")


def has_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_regions(spark, sf_dir).filter("ord = 0").select("img_id", regions.has_subtitle("score").alias("likely"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = carriers.pixels(spark, sf_dir)
    to = regions.to_image("r", "g", WIDTH, HEIGHT, 640, 480)
    back = regions.to_display(regions.rect(F.col("r"), F.col("g"), F.col("b"), F.col("b")), WIDTH, HEIGHT, 640, 480)
    return px.select("img_id", "y", "x", to["x"].alias("image_x"), to["y"].alias("image_y"), back["x"].alias("shown_x"), back["y"].alias("shown_y"), back["w"].alias("shown_w"), regions.roi_is_valid("r", "b").alias("valid"))


def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ocr.lines(carriers.words(spark, sf_dir, together=True))
    return found.select("line_id", "text", F.round("confidence", 6).alias("confidence"))


def word_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.words(spark, sf_dir).select("line_id", "pos", tx.word_confidence("text", "w", "h").alias("confidence"))


def best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.best_pass(carriers.attempts(spark, sf_dir)).select("video_id", "ts_ms", "mode", "text", F.round("confidence", 6).alias("confidence"))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told while frames are read, were each to take 40 ms, or 400 in every seventh video."""
    whole = Window.partitionBy("video_id")
    each = F.when(F.col("video_id") % 7 == 0, 400).otherwise(40)
    done = carriers.frames(spark, sf_dir).select("video_id", F.row_number().over(whole.orderBy("ts_ms")).alias("done"), F.count(F.lit(1)).over(whole).alias("total"))
    return ocr.throughput(done.withColumn("seconds", F.col("done") * each / 1000)).select("video_id", "done", "percent", "left_s", "said")


def frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = carriers.frames(spark, sf_dir).select("video_id", F.format_string("frame_%09d.png", "ts_ms").alias("path"))
    return frames.frame_manifest(named, 3)


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("  Duration: "), F.substring(F.replace(srt.srt_time("end_ms"), F.lit(","), F.lit(".")), 1, 12), F.lit(", start: 0"))
    told = F.when(F.col("idx") % 9 == 0, F.lit("no such file")).otherwise(said)
    done = F.concat(F.lit("frame=1 time="), F.replace(srt.srt_time("start_ms"), F.lit(","), F.lit(".")))
    total = frames.video_duration(told)
    return carriers.subs(spark, sf_dir).select("video_id", "idx", F.round(total, 3).alias("seconds"), frames.progress(done, total).alias("percent"))


def srt_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("idx") % 7 == 0, F.lit("00:01")).when(F.col("idx") % 11 == 0, F.lit("a:00:01,000")).when(F.col("idx") % 13 == 0, F.lit("00:00:01,5")).otherwise(srt.srt_time("start_ms"))
    return carriers.subs(spark, sf_dir).select("video_id", "idx", srt.srt_time("start_ms").alias("formatted"), srt.parse_time(broken).alias("ms"))


def frame_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, m, s = (F.expr(f"cast(start_ms div {u} % {n} as int)") for u, n in ((3_600_000, 100), (60_000, 60), (1000, 60)))
    return carriers.subs(spark, sf_dir).select("video_id", "idx", frames.frame_at(h, m, s, 4).alias("frame"), frames.time_at("idx", 4).alias("at"))


def srt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with text, written as SRT and read again."""
    full = carriers.subs(spark, sf_dir).filter("text <> ''")
    files = srt.srt_strings(full).select(F.col("video_id").cast("string").alias("path"), "content")
    return srt.parse_files(files).select(F.col("path").cast("long").alias("video_id"), "idx", "start_ms", "end_ms", "text")


def refine_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.refine_timing(carriers.subs(spark, sf_dir), carriers.frame_text(spark, sf_dir), 50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to cues, cleaned and repaired, summed up by video."""
    cues = detection.detect_subtitles(carriers.frames(spark, sf_dir))
    return cues.transform(cleaning.clean_subtitles).transform(timing.auto_fix).transform(timing.time_statistics)


def queries() -> dict[str, Query]:
    return {
        "shift_time": on_subs(timing.shift_time, -700),
        "fix_overlap": on_subs(timing.fix_overlap, 30),
        "extend_duration": on_subs(timing.extend_duration),
        "min_duration": on_subs(timing.min_duration),
        "max_duration": on_subs(timing.max_duration),
        "auto_fix": on_subs(timing.auto_fix),
        "adjust_gaps": on_subs(timing.adjust_gaps),
        "time_issues": on_subs(timing.time_issues),
        "time_statistics": on_subs(timing.time_statistics),
        "validate_subtitles": lambda spark, sf_dir: cleaning.validate(carriers.subs(spark, sf_dir), carriers.videos(spark, sf_dir)),
        "subtitle_statistics": on_subs(cleaning.statistics),
        "statistics_text": on_subs(lambda df: cleaning.statistics_text(cleaning.statistics(df))),
        "count_valid": on_subs(cleaning.count_valid),
        "fix_overlapping_times": on_subs(cleaning.fix_overlapping_times),
        "fix_timeline": on_subs(detection.fix_timeline),
        "reindex": on_subs(lambda df: cleaning.reindex(df.withColumn("idx", F.col("idx") * 3 + 5))),
        "filter_noise": on_subs(detection.filter_noise),
        "remove_invalid": on_subs(cleaning.remove_invalid),
        "merge_short": on_subs(cleaning.merge_short),
        "merge_near_duplicates": on_subs(detection.merge_near_duplicates),
        "merge_continuations": on_subs(detection.merge_continuations),
        "merge_gapped": on_subs(detection.merge_gapped),
        "merge_adjacent": on_subs(detection.merge_adjacent),
        "grid": on_subs(cleaning.grid),
        "clean_subtitles": on_subs(cleaning.clean_subtitles),
        "rle_frames": lambda spark, sf_dir: detection.runs(carriers.frames(spark, sf_dir)),
        "raw_spans": lambda spark, sf_dir: detection.raw_spans(carriers.frames(spark, sf_dir)),
        "detect_subtitles": lambda spark, sf_dir: detection.detect_subtitles(carriers.frames(spark, sf_dir)),
        "detect_clean_fix": pipeline,
        "score_text": on_frames(lambda: dict(score=tx.score_text("text"))),
        "alnum_ratio": on_frames(lambda: dict(ratio=tx.alnum_ratio("text"))),
        "clean_text": on_lines(lambda: dict(text=tx.clean_text("text"))),
        "normalize_cmp": on_frames(lambda: dict(text=tx.normalize_for_comparison("text"))),
        "is_better_text": on_pairs(lambda: dict(better=tx.is_better_text("text", "prev"))),
        "similarity": on_pairs(lambda: dict(similarity=F.round(tx.similarity("text", "prev", "norm", "prev_norm"), 9))),
        "levenshtein": on_pairs(lambda: dict(distance=F.levenshtein("text", "prev"))),
        "adaptive_threshold": lambda spark, sf_dir: spark.range(1, 11).select(F.col("id").alias("fps"), F.round(tx.adaptive_threshold(F.col("id")), 6).alias("threshold")),
        "normalize_ocr": on_lines(lambda: dict(text=tx.normalize_ocr("text"))),
        "text_quality": on_lines(lambda: dict(quality=F.round(tx.quality_of("text"), 9))),
        "quality_score": on_lines(lambda: dict(confidence=F.round(tx.confidence_with_quality("text", F.lit(80.0)), 9))),
        "cjk_flag": on_subs(lambda df: df.select("video_id", "idx", tx.has_cjk("text").alias("cjk"), tx.cjk_count("text").alias("n"))),
        "clean_ocr_text": on_lines(lambda: dict(text=tx.clean_ocr_text("text"))),
        "dedup_lines": on_lines(lambda: dict(text=tx.remove_duplicate_lines("text"))),
        "split_long": lambda spark, sf_dir: cleaning.split_long(carriers.lines(spark, sf_dir).select(F.col("line_id").alias("video_id"), F.lit(1).alias("idx"), F.lit(1000).cast("long").alias("start_ms"), F.lit(9000).cast("long").alias("end_ms"), "text")),
        "trim_ocr": on_lines(lambda: dict(text=tx.trim_ocr_text("text"))),
        "remove_noise": on_lines(lambda: dict(text=tx.remove_ocr_noise("text"))),
        "word_confidence": word_confidence,
        "line_confidence": line_confidence,
        "best_pass": best_pass,
        "empty_rate": lambda spark, sf_dir: ocr.empty_rate(carriers.frames(spark, sf_dir)),
        "throughput": throughput,
        "is_video": lambda spark, sf_dir: carriers.table(spark, sf_dir, "part").select("p_partkey", frames.is_video(F.concat("p_name", F.element_at(F.array(*map(F.lit, [".MP4", ".mkv", ".txt", ".mov"])), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("video")),
        "frame_manifest": frame_manifest,
        "duration_parse": duration_parse,
        "srt_time_parse": srt_time_parse,
        "frame_seek": frame_seek,
        "srt_export": on_subs(srt.srt_strings),
        "srt_roundtrip": srt_roundtrip,
        "prompt": on_subs(prompt.prompts, "chi_sim"),
        "prompt_stats": on_subs(lambda df: prompt.prompt_statistics(prompt.prompts(df, "jpn"))),
        "genre": on_subs(prompt.genres, "chi_sim"),
        "gray": lambda spark, sf_dir: pixels.with_gray(carriers.pixels(spark, sf_dir)),
        "contrast_lut": lambda spark, sf_dir: pixels.contrast_table(spark),
        "otsu": on_gray(pixels.otsu_thresholds),
        "otsu_binary": on_gray(pixels.otsu),
        "color_mask": lambda spark, sf_dir: pixels.color_mask(carriers.pixels(spark, sf_dir)),
        "adaptive_mean": on_gray(pixels.adaptive),
        "dilate": on_gray(pixels.dilate),
        "erode": on_gray(pixels.erode),
        "close_gaps": on_gray(pixels.close_gaps),
        "region_score": on_gray(lambda v: pixels.region_score(v).withColumn("score", F.round("score", 9))),
        "region_argmax": region_argmax,
        "region_weighted": region_weighted,
        "has_subtitle": has_subtitle,
        "coordinates": coordinates,
        "refine_timing": refine_timing,
        "optimal_fps": lambda spark, sf_dir: timing.optimal_fps(carriers.frame_text(spark, sf_dir), videos=carriers.videos(spark, sf_dir)),
    }


W = "OVER (PARTITION BY video_id ORDER BY start_ms, idx)"
CUE = "video_id, idx, start_ms, CAST(end_ms AS BIGINT) AS end_ms, text"


def time_text(ms: str) -> str:
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


def subs_sql(end: str = "end_ms", start: str = "start_ms", where: str = "true") -> str:
    return f"WITH {SUBS_SQL}, s AS (SELECT *, lead(start_ms) {W} AS n FROM subs) SELECT video_id, idx, {start} AS start_ms, CAST({end} AS BIGINT) AS end_ms, text FROM s WHERE {where}"


def texts_sql(columns: str, where: str = "true") -> str:
    return f"WITH {FRAMES_SQL}, f AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY ts_ms) AS prev FROM frames) SELECT video_id, ts_ms, {columns} FROM f WHERE {where}"


def lines_sql(column: str) -> str:
    return f"SELECT doc_id AS line_id, {column} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def gray_sql(rest: str) -> str:
    return f"WITH {PIXELS_SQL}, gray AS (SELECT img_id, y, x, (r * 77 + g * 150 + b * 29) >> 8 AS v FROM pixels) {rest}"


def near_sql(take: str, source: str, name: str, radius: int = 1) -> str:
    return f"""{name}_r AS (SELECT img_id, y, x, {take}(v) OVER (PARTITION BY img_id, y ORDER BY x RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {source}),
    {name} AS (SELECT img_id, y, x, {take}(v) OVER (PARTITION BY img_id, x ORDER BY y RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {name}_r)"""


def oracle_sql() -> dict[str, str]:
    alnum, special = (lambda t: ALNUM.format(t)), (lambda t: SPECIAL.format(t))
    ratio = lambda t: f"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE {alnum(t)} / length({t}) END"
    trim = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    lined = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim.format('x')}), lambda x: x <> '')"
    norm = lambda t: f"regexp_replace(translate(lower({t}), '01|!$@', 'oiiisa'), '[^a-z0-9_ {fold_sql.WIDE}]', '', 'g')"
    bars = "regexp_replace(replace(replace(text, '|', ''), '_', ''), '  +', ' ', 'g')"
    squeezed = "replace(replace(text, ' ', ''), chr(10), '')"
    kinds = lambda t: f"CASE WHEN length({t}) = 0 THEN 0 ELSE len(list_distinct(string_split({t}, ''))) END"
    issue = "SELECT video_id, idx, '{0}' AS issue_type, {1} AS description FROM s WHERE {2}"
    ms = "CAST(end_ms - start_ms AS VARCHAR) || 'ms'"
    error = "SELECT video_id, idx, 'Subtitle ' || CAST(idx AS VARCHAR) || {0} AS error FROM s WHERE {1}"
    entry = f"CAST(idx AS VARCHAR) || chr(10) || {time_text('start_ms')} || ' --> ' || {time_text('end_ms')} || chr(10) || text || chr(10)"
    body = f"string_agg({entry}, chr(10) ORDER BY start_ms, idx) || chr(10)"
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def prompt_sql(language: str, genre: str, style: str) -> str:
        head = prompt.HEAD.replace("{source}", prompt.SOURCE_NAMES[language]).replace("{genre}", genre).replace("{style}", style)
        first, last = prompt.LONG.split("{n}")
        return f"WITH {SUBS_SQL} SELECT video_id, {quoted(head)} || CASE WHEN count(*) > 50 THEN {quoted(first)} || CAST(count(*) AS VARCHAR) || {quoted(last)} ELSE '' END || {quoted(prompt.BODY)} || {body} || {quoted(prompt.TAIL)} AS prompt FROM subs GROUP BY video_id"

    old = f"WITH {SUBS_SQL} SELECT video_id, bool_or(regexp_matches(text, '{'|'.join(prompt.ANCIENT)}')) AS a FROM subs GROUP BY video_id"
    word = f"least(100.0, greatest(0.0, 85.0 + CASE WHEN length(text) >= 3 THEN 5 ELSE 0 END + CASE WHEN length(text) >= 5 THEN 3 ELSE 0 END + CASE WHEN length(text) = 1 THEN CASE WHEN {alnum('text')} = 1 THEN -5 ELSE -25 END ELSE 0 END + CASE WHEN length(text) > 1 AND {alnum('text')} * 2 < length(text) THEN -15 ELSE 0 END + CASE WHEN regexp_matches(text, '[{CJK}]') THEN 5 ELSE 0 END + CASE WHEN w < 8 OR h < 8 THEN -20 ELSE 0 END + CASE WHEN w / greatest(1.0, h) BETWEEN 0.2 AND 15 THEN 3 ELSE 0 END))::DOUBLE"
    rated = "CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + CASE WHEN cj > 0 THEN 0.2::DOUBLE + least(0.15::DOUBLE, cj * 0.03::DOUBLE) ELSE (al::DOUBLE / n - 0.5) * 0.3::DOUBLE END + CASE WHEN n BETWEEN 2 AND 200 THEN 0.1 WHEN n = 1 AND cj > 0 THEN 0.05 ELSE 0 END + CASE WHEN mk > 6 THEN -0.12 WHEN mk > 3 THEN -0.05 ELSE 0 END + CASE WHEN n <= 3 THEN 0 WHEN ds <= 1 THEN -0.35 WHEN ds <= 2 AND cj = 0 THEN -0.20 WHEN ds::DOUBLE / n < 0.15 AND cj = 0 THEN -0.10 ELSE 0 END)) END"
    factor = "CASE WHEN length(text) < 2 THEN 0.5 WHEN length(text) < 4 THEN 0.7 ELSE 1.0 END * CASE WHEN al::DOUBLE / n < 0.3 THEN 0.4 WHEN al::DOUBLE / n < 0.5 THEN 0.7 ELSE 1.0 END"
    measured_from = lambda source, columns: f"(SELECT *, length(c) AS n, {alnum('c')} AS al, length(c) - length(regexp_replace(c, '[{CJK}]', '', 'g')) AS cj, {kinds('c')} AS ds, {kinds(chr(114))} AS mk FROM (SELECT *, regexp_replace(c, '[\\p{{L}}\\p{{Nd}}\\s]', '', 'g') AS r FROM (SELECT {columns}, {squeezed} AS c FROM {source})))"
    measured = measured_from("(SELECT doc_id, coalesce(text, '') AS text FROM documents)", "doc_id, text")
    lowered = lambda conf: f"CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0 WHEN {alnum('text')} = 0 THEN 5.0 ELSE least(100.0, greatest(0.0, {conf} * {factor} * CASE WHEN length(text) > 3 AND {kinds('text')} <= 2 THEN 0.3 ELSE 1.0 END)) END"
    line_sql = f"""WITH {WORDS_SQL}, v AS (SELECT *, {word} AS conf, length(text) AS n FROM words),
    r AS (SELECT line_id, row, string_agg(text, ' ' ORDER BY pos) AS text, sum(conf * n) AS s, sum(n) AS n FROM v GROUP BY line_id, row),
    i AS (SELECT line_id, string_agg(text, chr(10) ORDER BY row) AS text, sum(s) / sum(n) AS mean FROM r GROUP BY line_id)
    SELECT line_id, text, round(({lowered('mean')})::DOUBLE, 6) AS confidence FROM {measured_from('i', 'line_id, mean, text')}"""
    plain = "replace(translate(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]'), lambda x: " + trim.format("x") + "), lambda x: x <> ''), chr(10)), '“”‘’', '\"\"'''''), '…', '...')"
    normal = trim.format("regexp_replace(regexp_replace(regexp_replace(" + plain + ", '[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{9f}]', '', 'g'), '^\\|+\\s*', ''), '\\s*\\|+$', '')")
    texts = r"regexp_replace(regexp_replace(text, '^[\s\-_=+|]+|[\s\-_=+|]+$', '', 'g'), '\s+', ' ', 'g')"
    runs = f"""WITH {FRAMES_SQL}, c AS (SELECT video_id, ts_ms, CASE WHEN length(text) >= 2 THEN text ELSE '' END AS text FROM frames),
    d AS (SELECT *, CASE WHEN lag(text) OVER o IS NULL OR lag(text) OVER o <> text OR ts_ms - lag(ts_ms) OVER o > 1000 THEN 1 ELSE 0 END AS b FROM c WINDOW o AS (PARTITION BY video_id ORDER BY ts_ms)),
    e AS (SELECT *, sum(b) OVER (PARTITION BY video_id ORDER BY ts_ms) AS k FROM d)
    SELECT video_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n, first(text) AS text FROM e GROUP BY video_id, k"""
    edge = "lag(v) OVER (PARTITION BY img_id, y ORDER BY x)", "lag(v) OVER (PARTITION BY img_id, x ORDER BY y)"
    score = "least(1.0, CASE WHEN br BETWEEN 0.02 AND 0.50 THEN (1 - abs(br - 0.15) / 0.35) * 0.3 ELSE 0 END + CASE WHEN er BETWEEN 0.005 AND 0.20 THEN er / 0.10 * 0.4 ELSE 0 END + CASE WHEN cr BETWEEN 0.002 AND 0.15 THEN cr / 0.05 * 0.3 ELSE 0 END)::DOUBLE"
    region = gray_sql(f""", d AS (SELECT *, CASE WHEN {edge[0]} IS NOT NULL AND {edge[1]} IS NOT NULL THEN greatest(abs(v - {edge[0]}), abs(v - {edge[1]})) END AS d FROM gray),
    t AS (SELECT img_id, count(*) AS total, count(*) FILTER (v > 200) AS bright, count(*) FILTER (d > 50) AS edges, count(*) FILTER (d > 100) AS contrasts FROM d GROUP BY img_id),
    u AS (SELECT *, bright::DOUBLE / total AS br, edges::DOUBLE / total AS er, contrasts::DOUBLE / total AS cr FROM t), """).rstrip(", ")
    places = ", ".join(f"({k}, {x}, {y}, {w}, {h}, {pr})" for k, (x, y, w, h, pr) in enumerate([(3, 21, 13, 4, 1.0), (0, 20, 20, 5, 0.9), (2, 21, 16, 4, 0.85), (3, 0, 13, 3, 0.5)]))
    sides = "lag(v) OVER (PARTITION BY img_id, ord, y ORDER BY x)", "lag(v) OVER (PARTITION BY img_id, ord, x ORDER BY y)"
    candidates = gray_sql(f""", p AS (SELECT * FROM (VALUES {places}) AS p(ord, px, py, pw, ph, pr)), i AS (SELECT * FROM gray JOIN p ON x >= px AND x < px + pw AND y >= py AND y < py + ph),
    d AS (SELECT *, CASE WHEN {sides[0]} IS NOT NULL AND {sides[1]} IS NOT NULL THEN greatest(abs(v - {sides[0]}), abs(v - {sides[1]})) END AS d FROM i),
    t AS (SELECT img_id, ord, px, py, pw, ph, pr, count(*) FILTER (v > 200) / count(*)::DOUBLE AS br, count(*) FILTER (d > 50) / count(*)::DOUBLE AS er, count(*) FILTER (d > 100) / count(*)::DOUBLE AS cr FROM d GROUP BY ALL),
    u AS (SELECT *, {score} AS score FROM t)""")
    argmax = f"""{candidates}, b AS (SELECT *, score * pr::DOUBLE AS v, row_number() OVER (PARTITION BY img_id ORDER BY score * pr::DOUBLE DESC, ord) AS k FROM u),
    z AS (SELECT img_id, greatest(0, px - pw // 20) AS nx, greatest(0, py - ph // 10) AS ny, pw + pw // 20 * 2 AS nw, ph + ph // 10 * 2 AS nh, least(100.0, greatest(0.0, v) * 100)::DOUBLE AS confidence FROM b WHERE k = 1),
    best AS (SELECT img_id, CAST(nx AS INTEGER) AS x, CAST(ny AS INTEGER) AS y, CAST(least(20 - nx, nw) AS INTEGER) AS w, CAST(least(27 - ny, nh) AS INTEGER) AS h, confidence FROM z)"""
    weighted = ", ".join(f"CAST(CASE WHEN sum(confidence) > 0 THEN trunc(round(sum({c} * confidence) / sum(confidence), 6)) ELSE arg_min({c}, img_id) END AS INTEGER) AS {c}" for c in "xywh")
    otsu = gray_sql(""", h AS (SELECT img_id, v, count(*) AS n FROM gray GROUP BY img_id, v),
    a AS (SELECT *, sum(n) OVER o AS wb, sum(n * v) OVER o AS sb, sum(n) OVER (PARTITION BY img_id) AS w, sum(n * v) OVER (PARTITION BY img_id) AS s FROM h WINDOW o AS (PARTITION BY img_id ORDER BY v)),
    b AS (SELECT *, round(wb::DOUBLE * (w - wb) * (sb::DOUBLE / wb - (s - sb)::DOUBLE / nullif(w - wb, 0)) * (sb::DOUBLE / wb - (s - sb)::DOUBLE / nullif(w - wb, 0)), 4) AS between_ FROM a),
    c AS (SELECT img_id, v, row_number() OVER (PARTITION BY img_id ORDER BY CASE WHEN between_ > 0 THEN between_ END DESC NULLS LAST, v) AS k, between_ FROM b),
    t AS (SELECT img_id, CASE WHEN between_ > 0 THEN v ELSE 128 END AS threshold FROM c WHERE k = 1)""")
    grid_text = f"video_id, idx, {time_text('start_ms')} AS start, {time_text('end_ms')} AS \"end\", {ms} AS duration, replace(text, chr(10), ' | ') AS text"
    end_side = "SELECT s.video_id, s.idx, min(f.ts_ms) AS t FROM subs s JOIN ft f ON f.video_id = s.video_id AND {0} AND f.ts_ms BETWEEN {1} AND {2} AND (f.ts_ms - {1}) % 50 = 0 GROUP BY ALL"
    before = lambda c, n: f"greatest(0, s.{c} - {n})"
    out = {
        "shift_time": f"WITH {SUBS_SQL} SELECT video_id, idx, greatest(0, start_ms - 700) AS start_ms, greatest(greatest(0, start_ms - 700) + 100, end_ms - 700) AS end_ms, text FROM subs",
        "fix_overlap": subs_sql(FIX),
        "extend_duration": subs_sql("CASE WHEN n - end_ms > 1000 THEN least(end_ms + 3000, n - 50) ELSE end_ms END"),
        "min_duration": subs_sql("greatest(end_ms, start_ms + 500)"),
        "max_duration": subs_sql("least(end_ms, start_ms + 10000)"),
        "auto_fix": f"WITH {SUBS_SQL}, {fold_sql.auto_fix('out_', 'subs')} SELECT * FROM out_",
        "adjust_gaps": f"""WITH RECURSIVE {SUBS_SQL}, s AS (SELECT *, row_number() {W} AS k FROM subs),
        r AS (SELECT s.*, start_ms AS ns FROM s WHERE k = 1 UNION ALL
          SELECT s.*, CASE WHEN s.start_ms - r.end_ms <> 100 AND s.start_ms - 100 <= r.ns THEN r.ns + 200 ELSE s.start_ms END FROM r JOIN s ON s.video_id = r.video_id AND s.k = r.k + 1),
        t AS (SELECT *, lead(start_ms) OVER o AS n FROM r WINDOW o AS (PARTITION BY video_id ORDER BY k))
        SELECT video_id, idx, CAST(ns AS BIGINT) AS start_ms, CAST(CASE WHEN n IS NULL OR n - end_ms = 100 THEN end_ms WHEN n - 100 <= ns THEN ns + 100 ELSE n - 100 END AS BIGINT) AS end_ms, text FROM t""",
        "time_issues": f"WITH {SUBS_SQL}, s AS (SELECT *, lead(start_ms) {W} AS n, lead(idx) {W} AS ni FROM subs) " + " UNION ALL ".join([issue.format("InvalidDuration", f"'Duration <= 0: ' || {ms}", "end_ms <= start_ms"), issue.format("TooShort", f"'Duration quá ngắn: ' || {ms}", "end_ms - start_ms < 200"), issue.format("TooLong", f"'Duration quá dài: ' || {ms}", "end_ms - start_ms > 15000"), issue.format("Overlap", "'Overlap với subtitle ' || CAST(ni AS VARCHAR)", "end_ms > n")]),
        "time_statistics": f"WITH {SUBS_SQL} {fold_sql.time_statistics('subs')}",
        "validate_subtitles": f"WITH {SUBS_SQL}, s AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY idx) AS n, lead(idx) OVER (PARTITION BY video_id ORDER BY idx) AS ni FROM subs) " + " UNION ALL ".join([error.format("': Text trống'", "NOT regexp_matches(text, '\\S')"), error.format("': StartTime < 0'", "start_ms < 0"), error.format("': EndTime <= StartTime'", "end_ms <= start_ms"), error.format("': Overlap với subtitle ' || CAST(ni AS VARCHAR)", "end_ms > n"), "SELECT c_custkey, NULL, 'Không có subtitle' FROM customer WHERE c_custkey NOT IN (SELECT video_id FROM subs)"]),
        "subtitle_statistics": f"WITH {SUBS_SQL} SELECT video_id, count(*) AS total, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_duration, CAST(trunc(avg(end_ms - start_ms)) AS BIGINT) AS avg_duration, min(end_ms - start_ms) AS min_duration, max(end_ms - start_ms) AS max_duration, avg(len(string_split(text, chr(10)))) AS avg_lines FROM subs GROUP BY video_id",
        "statistics_text": f"WITH {SUBS_SQL} SELECT video_id, printf('Total: %d | Avg: %dms | Min: %dms | Max: %dms | Avg Lines: %.1f', count(*), CAST(trunc(avg(end_ms - start_ms)) AS BIGINT), CAST(min(end_ms - start_ms) AS BIGINT), CAST(max(end_ms - start_ms) AS BIGINT), round(avg(len(string_split(text, chr(10)))), 1)) AS text FROM subs GROUP BY video_id",
        "count_valid": f"WITH {SUBS_SQL} SELECT video_id, count(*) FILTER (regexp_matches(text, '\\S')) AS valid FROM subs GROUP BY video_id",
        "fix_overlapping_times": subs_sql("CASE WHEN end_ms > n THEN CASE WHEN n - 30 - start_ms < 100 THEN start_ms + 100 ELSE n - 30 END ELSE end_ms END"),
        "fix_timeline": f"WITH {SUBS_SQL}, {fold_sql.fix_timeline('out_', 'subs')} SELECT * FROM out_",
        "reindex": f"WITH {SUBS_SQL} SELECT video_id, CAST(row_number() {W} AS INTEGER) AS idx, start_ms, end_ms, text FROM subs",
        "filter_noise": subs_sql(where=fold_sql.NO_NOISE),
        "remove_invalid": subs_sql(where=fold_sql.VALID),
        "grid": f"WITH {SUBS_SQL} SELECT {grid_text} FROM subs",
        "rle_frames": runs,
        "score_text": texts_sql(f"CAST(length(text) + 2 * {alnum('text')} + 3 * (length(text) - length(regexp_replace(text, '[{CJK}]', '', 'g'))) - 2 * {special('text')} AS INTEGER) AS score"),
        "alnum_ratio": texts_sql(f"{ratio('text')} AS ratio"),
        "clean_text": lines_sql(f"{texts} AS text"),
        "normalize_cmp": texts_sql(f"{norm('text')} AS text"),
        "is_better_text": texts_sql(f"CASE WHEN length(prev) = 0 THEN true WHEN length(text) = 0 THEN false ELSE length(text) > length(prev) + 3 OR {ratio('text')} > {ratio('prev')} + 0.05 OR (abs(length(text) - length(prev)) <= 2 AND {special('text')} < {special('prev')}) END AS better", "prev IS NOT NULL"),
        "similarity": f"WITH {FRAMES_SQL}, f AS (SELECT video_id, ts_ms, text, lag(text) OVER (PARTITION BY video_id ORDER BY ts_ms) AS prev FROM frames), g AS (SELECT *, {fold_sql.norm('text')} AS a, {fold_sql.norm('prev')} AS b FROM f WHERE prev IS NOT NULL) SELECT video_id, ts_ms, round({fold_sql.alike('a', 'b', 'text', 'prev')}, 9) AS similarity FROM g",
        "levenshtein": texts_sql(f"CAST(levenshtein(translate(text, '{fold_sql.WIDE}', '{fold_sql.NARROW}'), translate(prev, '{fold_sql.WIDE}', '{fold_sql.NARROW}')) AS INTEGER) AS distance", "prev IS NOT NULL"),
        "adaptive_threshold": "SELECT i AS fps, round((0.60 + CASE WHEN i <= 2 THEN 0.03 WHEN i = 3 THEN -0.02 WHEN i = 4 THEN -0.05 WHEN i = 5 THEN -0.08 ELSE -0.10 END)::DOUBLE, 6) AS threshold FROM range(1, 11) t(i)",
        "text_quality": f"SELECT doc_id AS line_id, round(({rated})::DOUBLE, 9) AS quality FROM {measured}",
        "quality_score": f"SELECT doc_id AS line_id, round(({lowered('80.0')})::DOUBLE, 9) AS confidence FROM {measured}",
        "cjk_flag": f"WITH {SUBS_SQL} SELECT video_id, idx, regexp_matches(text, '[{CJK}]') AS cjk, CAST(length(text) - length(regexp_replace(text, '[{CJK}]', '', 'g')) AS INTEGER) AS n FROM subs",
        "clean_ocr_text": lines_sql(f"{fold_sql.CLEAN_OCR} AS text"),
        "normalize_ocr": lines_sql(f"{normal} AS text"),
        "line_confidence": line_sql,
        "throughput": f"""WITH {FRAMES_SQL}, f AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms) AS done, count(*) OVER (PARTITION BY video_id) AS total FROM frames),
        g AS (SELECT *, done / (done * CASE WHEN video_id % 7 = 0 THEN 400 ELSE 40 END / 1000.0::DOUBLE) AS fps FROM f WHERE done % greatest(1, total // 50) = 0),
        h AS (SELECT *, CAST(trunc(done::DOUBLE / total * 100) AS INTEGER) AS percent, CAST(trunc((total - done) / (fps + 0.001::DOUBLE)) AS BIGINT) AS left_s FROM g)
        SELECT video_id, CAST(done AS INTEGER) AS done, percent, left_s, printf('OCR: %d/%d (%d%%) - %.1f fps - ETA: %02d:%02d', done, total, percent, fps, left_s // 60 % 60, left_s % 60) AS said FROM h""",
        "dedup_lines": lines_sql(f"coalesce(array_to_string(list_filter({lined}, lambda x, i: list_position({lined}, x) = i), chr(10)), '') AS text"),
        "trim_ocr": lines_sql(f"array_to_string({lined}, chr(10)) AS text"),
        "remove_noise": lines_sql(f"{trim.format(bars)} AS text"),
        "split_long": f"""SELECT doc_id AS video_id, 1 AS idx, CAST(CASE WHEN n > 2 THEN 1000 + p * (8000 // n) ELSE 1000 END AS BIGINT) AS start_ms,
        CAST(CASE WHEN n > 2 THEN least(1000 + least(p + 2, n) * (8000 // n), 9000) ELSE 9000 END AS BIGINT) AS end_ms, CASE WHEN n > 2 THEN array_to_string(l[p + 1 : p + 2], chr(10)) ELSE text END AS text
        FROM (SELECT *, unnest(CASE WHEN n > 2 THEN range(0, n, 2) ELSE [0] END) AS p FROM (SELECT doc_id, text, {lined} AS l, len({lined}) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))""",
        "word_confidence": f"WITH {WORDS_SQL} SELECT line_id, pos, {word} AS confidence FROM words",
        "best_pass": f"""WITH {ATTEMPTS_SQL}, a AS (SELECT video_id, ts_ms, ord, mode, text, conf, ord > 2 AS back, regexp_matches(text, '\\S') AS read, conf * 0.7::DOUBLE + 30 * ({rated})::DOUBLE AS adj FROM {measured_from('attempts', 'video_id, ts_ms, ord, mode, conf, text')}),
        b AS (SELECT *, CASE WHEN back THEN 1 ELSE 0 END AS last_resort, coalesce(max(CASE WHEN adj >= 92 AND length(text) >= 3 AND NOT back AND read THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, ts_ms ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY video_id, ts_ms ORDER BY last_resort, CASE WHEN back THEN 0 ELSE adj END DESC, ord) AS k FROM b WHERE read AND (back OR late = 0)),
        d AS (SELECT DISTINCT video_id, ts_ms FROM attempts)
        SELECT d.video_id, d.ts_ms, c.mode, coalesce(c.text, '') AS text, coalesce(round((CASE WHEN back THEN conf ELSE adj END)::DOUBLE, 6), 0.0) AS confidence FROM d LEFT JOIN c ON c.video_id = d.video_id AND c.ts_ms = d.ts_ms AND k = 1""",
        "empty_rate": f"WITH {FRAMES_SQL} SELECT video_id, count(*) AS frames, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (trim(text) = '') > count(*) * 0.8 AS warned FROM frames GROUP BY video_id",
        "is_video": "SELECT p_partkey, p_partkey % 4 <> 2 AS video FROM part",
        "frame_manifest": f"WITH {FRAMES_SQL}, f AS (SELECT video_id, 'frame_' || lpad(CAST(ts_ms AS VARCHAR), 9, '0') || '.png' AS path, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms) AS k FROM frames) SELECT video_id, CAST(k AS INTEGER) AS frame_no, path, CAST(trunc((k - 1) * 1000.0 / 3.0) AS BIGINT) AS ts_ms FROM f",
        "duration_parse": f"WITH {SUBS_SQL} SELECT video_id, idx, round(CASE WHEN idx % 9 = 0 THEN 0 ELSE end_ms / 1000.0 END::DOUBLE, 3) AS seconds, CASE WHEN idx % 9 = 0 OR end_ms = 0 THEN NULL ELSE CAST(least(100, trunc((start_ms // 3600000 * 3600 + start_ms // 60000 % 60 * 60 + (start_ms % 60000) / 1000.0::DOUBLE) / (end_ms // 3600000 * 3600 + end_ms // 60000 % 60 * 60 + (end_ms % 60000) / 1000.0::DOUBLE) * 100)) AS INTEGER) END AS percent FROM subs",
        "srt_time_parse": f"WITH {SUBS_SQL} SELECT video_id, idx, {time_text('start_ms')} AS formatted, CAST(CASE WHEN idx % 7 = 0 THEN 0 WHEN idx % 11 = 0 THEN 0 WHEN idx % 13 = 0 THEN 1005 ELSE start_ms END AS BIGINT) AS ms FROM subs",
        "frame_seek": f"WITH {SUBS_SQL} SELECT video_id, idx, CAST(start_ms // 1000 * 4 AS INTEGER) AS frame, lpad(CAST(idx // 4 // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(idx // 4 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(idx // 4 % 60 AS VARCHAR), 2, '0') AS at FROM subs",
        "srt_export": f"WITH {SUBS_SQL} SELECT video_id, {body} AS content FROM subs GROUP BY video_id",
        "srt_roundtrip": subs_sql(where="text <> ''").replace(" text FROM s", " regexp_replace(text, '\\n$', '') AS text FROM s"),
        "prompt": f"SELECT video_id, CASE WHEN a THEN x.prompt ELSE y.prompt END AS prompt FROM ({prompt_sql('chi_sim', prompt.GENRES['ancient'], prompt.STYLES['ancient'])}) x JOIN ({prompt_sql('chi_sim', prompt.GENRES['chinese'], prompt.STYLES['other'])}) y USING (video_id) JOIN ({old}) z USING (video_id)",
        "prompt_stats": f"SELECT video_id, CAST(length(prompt) AS INTEGER) AS chars, CAST(len(string_split(prompt, chr(10))) AS INTEGER) AS lines, length(prompt) > 100000 AS warned FROM ({prompt_sql('jpn', prompt.GENRES['jpn'], prompt.STYLES['anime'])})",
        "genre": f"SELECT video_id, CASE WHEN a THEN {quoted(prompt.GENRES['ancient'])} ELSE {quoted(prompt.GENRES['chinese'])} END AS genre, CASE WHEN a THEN {quoted(prompt.STYLES['ancient'])} ELSE {quoted(prompt.STYLES['other'])} END AS style FROM ({old})",
        "gray": gray_sql("SELECT img_id, y, x, CAST(v AS INTEGER) AS v FROM gray"),
        "contrast_lut": "SELECT CAST(i AS INTEGER) AS v, CAST(least(255, greatest(0, trunc(i::REAL * 1.4::REAL + 128::REAL * (1::REAL - 1.4::REAL)))) AS INTEGER) AS out FROM range(256) t(i)",
        "otsu": otsu + " SELECT img_id, CAST(threshold AS INTEGER) AS threshold FROM t",
        "otsu_binary": otsu + " SELECT g.img_id, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM gray g JOIN t USING (img_id)",
        "color_mask": f"""WITH {PIXELS_SQL}, p AS (SELECT *, (r + g + b) // 3 AS l, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pixels),
        q AS (SELECT *, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) * 255 // hi END AS s, lag(l) OVER a AS n1, lead(l) OVER a AS n2, lag(l) OVER c AS n3, lead(l) OVER c AS n4 FROM p WINDOW a AS (PARTITION BY img_id, y ORDER BY x), c AS (PARTITION BY img_id, x ORDER BY y))
        SELECT img_id, y, x, CASE WHEN (l >= 150 AND s <= 80) OR (r >= 180 AND g >= 160 AND b < 130 AND r + g > 360) OR (r < 130 AND g >= 180 AND b >= 180) OR (g >= 200 AND r >= 150 AND b < 130)
        OR (l >= 130 AND s <= 100 AND coalesce(l - (n1 + n2 + n3 + n4) // 4 > 40, false)) THEN 255 ELSE 0 END AS v FROM q""",
        "adaptive_mean": gray_sql(", a AS (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS n FROM gray WINDOW w AS (PARTITION BY img_id, y ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)), b AS (SELECT *, sum(s) OVER w AS ss, sum(n) OVER w AS nn FROM a WINDOW w AS (PARTITION BY img_id, x ORDER BY y RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT img_id, y, x, CASE WHEN v > ss // nn - 10 THEN 255 ELSE 0 END AS v FROM b"),
        "dilate": gray_sql(f", {near_sql('max', 'gray', 'd')} SELECT img_id, y, x, CAST(v AS INTEGER) AS v FROM d"),
        "erode": gray_sql(f", {near_sql('min', 'gray', 'd')} SELECT img_id, y, x, CAST(v AS INTEGER) AS v FROM d"),
        "close_gaps": gray_sql(f", {near_sql('max', 'gray', 'd')}, {near_sql('min', 'd', 'e')} SELECT img_id, y, x, CAST(v AS INTEGER) AS v FROM e"),
        "region_score": f"{region} SELECT img_id, total, bright, edges, contrasts, round({score}, 9) AS score FROM u",
        "region_argmax": f"{argmax} SELECT * FROM best",
        "region_weighted": f"{argmax} SELECT img_id % 7 AS video_id, {weighted}, max(confidence) AS confidence FROM best GROUP BY 1",
        "has_subtitle": f"{candidates} SELECT img_id, score > 0.15 AS likely FROM u WHERE ord = 0",
        "coordinates": f"WITH {PIXELS_SQL} SELECT img_id, y, x, CAST(greatest(0, least(trunc(r / 0.5), 1280)) AS INTEGER) AS image_x, CAST(greatest(0, least(trunc((g - 60) / 0.5), 720)) AS INTEGER) AS image_y, CAST(trunc(r * 0.5) AS INTEGER) AS shown_x, CAST(60 + trunc(g * 0.5) AS INTEGER) AS shown_y, CAST(trunc(b * 0.5) AS INTEGER) AS shown_w, r >= 10 AND b >= 10 AS valid FROM pixels",
        "refine_timing": f"WITH {SUBS_SQL}, {FRAMES_SQL}, ft AS (SELECT video_id, ts_ms, text <> '' AS h FROM frames), a AS ({end_side.format('f.h', before('start_ms', 800), 's.start_ms + 400')}), b AS ({end_side.format('NOT f.h', before('end_ms', 400), 's.end_ms + 800')}) SELECT s.video_id, s.idx, coalesce(a.t, s.start_ms) AS start_ms, coalesce(b.t, s.end_ms) AS end_ms, s.text FROM subs s LEFT JOIN a USING (video_id, idx) LEFT JOIN b USING (video_id, idx)",
        "optimal_fps": f"WITH {FRAMES_SQL}, f AS (SELECT video_id, text <> '' AS h, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM frames), m AS (SELECT * FROM f WHERE k >= greatest(0, n // 2 - least(n, 100) // 2) AND k < greatest(0, n // 2 - least(n, 100) // 2) + least(n, 100)), g AS (SELECT video_id, h <> coalesce(lag(h) OVER (PARTITION BY video_id ORDER BY k), false) AS c FROM m), c AS (SELECT video_id, count(*) FILTER (c) AS changes FROM g GROUP BY video_id) SELECT c_custkey AS video_id, changes, CASE WHEN changes IS NULL THEN 4 WHEN changes > 25 THEN 6 WHEN changes > 15 THEN 4 ELSE 2 END AS fps FROM customer LEFT JOIN c ON c.video_id = c_custkey",
    }
    return out | fold_sql.queries()
