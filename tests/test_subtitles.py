"""Hand-written sequences for exact rules, properties, and every query against its SQL."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge import schema
from captionforge.functions import text as tx
from captionforge.operators import cleaning, detection, folds, ocr, pixels, raster, regions, timing
from captionforge.sources import extract, frames, srt

SF = "/root/testdata/sf0.001"


def cues(spark, rows):
    return spark.createDataFrame([(1, i + 1, s, e, t) for i, (s, e, t) in enumerate(rows)], schema.SUBTITLES)


def times(df):
    return [(r["start_ms"], r["end_ms"]) for r in df.orderBy("start_ms", "idx").collect()]


def read(spark, *frames_):
    return spark.createDataFrame([(1, ts, t) for ts, t in frames_], schema.OCR)


class FakeEngine:
    """Reads the text that a rule gives for an image, and counts how often it is asked."""

    name = "fake"

    def __init__(self, rule):
        self.rule = rule

    def recognize(self, image):
        return self.rule(image)


CASES = {
    "end of input": ([(0, "hello"), (250, "hello"), (500, "hello")], [(0, 625, "hello")]),
    "short at the end": ([(0, "hi")], [(0, 500, "hi")]),
    "short before a change": ([(0, "abc"), (250, "xyzw")], [(0, 500, "abc"), (250, 750, "xyzw")]),
    "too short before a change": ([(0, "ab"), (250, "xyzw")], [(250, 750, "xyzw")]),
    "short before blanks": ([(0, "abc"), (250, ""), (500, ""), (750, ""), (1000, "")], [(0, 250, "abc")]),
    "blanks in between": ([(0, "hello"), (250, ""), (500, ""), (750, ""), (1000, "hello")], [(0, 1125, "hello")]),
    "no frames in between": ([(0, "hello"), (1250, "hello")], [(0, 500, "hello"), (1250, 1750, "hello")]),
    "confused letters": ([(0, "cl1ck"), (250, "click")], [(0, 375, "cl1ck")]),
    "one character": ([(0, "好"), (250, "好")], []),
}


def test_detection_by_hand(spark):
    rows = [(k, ts, t) for k, (given, _) in enumerate(CASES.values()) for ts, t in given]
    got = {}
    for r in detection.raw_spans(spark.createDataFrame(rows, schema.OCR)).collect():
        got.setdefault(r["video_id"], []).append((r["start_ms"], r["end_ms"], r["text"]))
    for k, (name, (_, want)) in enumerate(CASES.items()):
        assert sorted(got.get(k, [])) == sorted(want), name


def test_runs_do_not_change_the_fold():
    rnd, config = random.Random(4), schema.DetectorConfig()
    words = ["hello there", "hel1o there", "hello", "bye now", "bye  now!", "x", "", "", "好的好", "ok..."]
    for _ in range(400):
        fps, ts, given, last = rnd.randint(1, 10), 0, [], None
        for _ in range(rnd.randint(0, 40)):
            ts += (1000 // fps) * rnd.choice([1, 1, 1, 1, 2, 9])
            last = rnd.choice(words) if last is None or rnd.random() < 0.5 else last
            given.append((ts, last if len(last) > 1 else ""))
        gap = max(config.max_gap, 4 * (1000 // fps))
        single = [{"text": t, "first_ms": s, "last_ms": s, "n": 1} for s, t in given]
        grouped = []
        for r in single:
            if grouped and grouped[-1]["text"] == r["text"] and r["first_ms"] - grouped[-1]["last_ms"] <= gap:
                grouped[-1] = grouped[-1] | {"last_ms": r["last_ms"], "n": grouped[-1]["n"] + 1}
            else:
                grouped.append(r)
        assert detection.spans_of(single, fps, config) == detection.spans_of(grouped, fps, config)


def test_texts_agree_in_both_forms(spark):
    rnd = random.Random(6)
    letters = "aab01|!$@ é好にA..-_ \t9٣"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["", "one two three", "three two one"]
    pairs = [(a, rnd.choice(texts)) for a in texts] + [(a, a.upper()) for a in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", tx.similarity("a", "b").alias("s"), tx.score_text("a").alias("score"), tx.is_better_text("a", "b").alias("better"), tx.normalize_for_comparison("a").alias("n")).collect()
    for r in got:
        assert r["n"] == folds.normalized(r["a"]), repr(r["a"])
        assert abs(r["s"] - folds.similarity(r["a"], r["b"])) < 1e-9, r
        assert r["score"] == folds.score_text(r["a"]) and r["better"] == folds.is_better(r["a"], r["b"]), r


def test_text_cases(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lit = F.lit
    assert one(tx.clean_text(lit(" -_ a\n b |= "))) == "a b"
    assert one(tx.clean_ocr_text(lit("| a_b ~ c\n\n\n . \n好  d"))) == "a b c\n好 d"
    assert one(tx.normalize_ocr(lit("|| “x” \r\n\n y…\x07 ||"))) == '"x"\ny...'
    assert one(tx.remove_duplicate_lines(lit("b\na\n b \n"))) == "b\na"
    assert one(tx.remove_ocr_noise(lit(" a__b |  c "))) == "ab c"
    assert one(tx.quality_of(lit(""))) == 0 and one(tx.quality_of(lit("好"))) == pytest.approx(0.78)
    assert one(tx.quality_of(lit("hello"))) == pytest.approx(0.75) and one(tx.quality_of(lit("aaaa"))) == pytest.approx(0.40)
    assert one(tx.confidence_with_quality(lit("!!"), lit(90.0))) == 5 and one(tx.confidence_with_quality(lit("abc"), lit(90.0))) == pytest.approx(63)
    assert one(tx.word_confidence(lit("hello"), lit(50.0), lit(12.0))) == 96 and one(tx.word_confidence(lit("~"), lit(5.0), lit(5.0))) == 43
    assert one(tx.filled(lit(None).cast("string"))) == ""


def test_times_by_hand(spark):
    two = cues(spark, [(0, 2000, "a"), (1000, 3000, "b")])
    assert times(timing.fix_overlap(two, 30)) == [(0, 970), (1000, 3000)]
    assert times(detection.fix_timeline(two)) == [(0, 1490), (1000, 3000)]
    assert times(timing.extend_duration(cues(spark, [(0, 500, "a"), (9000, 9500, "b")]), 2000, 3000)) == [(0, 3500), (9000, 9500)]
    assert times(timing.shift_time(two, -1500)) == [(0, 500), (0, 1500)]
    assert times(timing.adjust_gaps(cues(spark, [(0, 500, "a"), (50, 400, "b"), (900, 950, "c")]))) == [(0, 100), (200, 800), (900, 950)]
    five = cleaning.split_long(cues(spark, [(0, 1000, "1\n2\n3\n4\n5")]))
    assert sorted((r["start_ms"], r["end_ms"], r["text"]) for r in five.collect()) == [(0, 400, "1\n2"), (400, 800, "3\n4"), (800, 1000, "5")]
    short = cleaning.merge_short(cues(spark, [(0, 100, "a"), (200, 240, "b"), (300, 900, "c"), (950, 2000, "d")]))
    assert sorted((r["start_ms"], r["end_ms"], r["text"]) for r in short.collect()) == [(0, 240, "a\nb"), (300, 900, "c"), (950, 2000, "d")]
    kept = cleaning.remove_invalid(cues(spark, [(0, 90, "ok"), (0, 70, "ok"), (0, 900, "好"), (0, 900, "x"), (0, 900, "~~"), (0, 900, "aaa"), (0, 900, " ")]))
    assert sorted(r["idx"] for r in kept.collect()) == [1, 3]
    assert Counter(r["issue_type"] for r in timing.time_issues(cues(spark, [(0, 0, "a"), (100, 20_000, "b"), (500, 900, "c")])).collect()) == Counter(InvalidDuration=1, TooShort=1, TooLong=1, Overlap=1)
    twice = timing.min_duration(timing.min_duration(two, 700), 700)
    assert times(twice) == times(timing.min_duration(two, 700))


def test_merges_by_hand(spark):
    rows = [(0, 500, "hello wor1d"), (600, 900, "hello world"), (5000, 5500, "to be..."), (5600, 6000, "or not")]
    out = lambda df: sorted((r["start_ms"], r["end_ms"], r["text"]) for r in df.collect())
    assert out(detection.merge_near_duplicates(cues(spark, rows)))[0][:2] == (0, 900)
    assert out(detection.merge_continuations(cues(spark, rows)))[-1] == (5000, 6000, "to be or not")
    assert len(out(detection.merge_gapped(cues(spark, rows)))) == 3
    # one letter of eleven is another: alike, but not nearly the same
    assert len(out(detection.merge_adjacent(cues(spark, rows)))) == 4


def test_srt(spark, tmp_path):
    df = cues(spark, [(0, 1500, "one\ntwo"), (3_723_004, 3_724_000, "three")])
    path = str(tmp_path / "a.srt")
    srt.export_srt(df, path)
    raw = open(path, "rb").read()
    assert raw.startswith(srt.BOM) and b"01:02:03,004 --> 01:02:04,000" in raw
    got = srt.import_srt(spark, path).orderBy("idx").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(0, 1500, "one\ntwo"), (3_723_004, 3_724_000, "three")]
    info = srt.file_info(spark, path).first()
    assert (info["subtitles"], info["duration_ms"], info["size"], info["duration"]) == (2, 3_724_000, len(raw), "01:02:04")
    assert srt.backup_file(path).endswith(".bak") and srt.backup_file(path).endswith(".bak1")
    with pytest.raises(ValueError):
        srt.export_srt(df.limit(0), path)
    odd = "1\n00:00:01,000 --> 00:00:02,000\nyear\n1984\nend\n"
    assert srt.parse_srt(odd) == [(1, 1000, 2000, "year\n1984\nend")]
    assert srt.parse_srt(odd, strict_reference=True) == [(1984, 0, 0, "year\nend")]
    assert spark.range(1).select(srt.parse_time(F.lit("00:00:01,5")).alias("x")).first()["x"] == 1005


def test_raster_forms_agree(spark):
    r = np.random.default_rng(3)
    img = r.integers(0, 256, (24, 40, 3)).astype(np.uint8)
    img[4:9, 5:30] = 255
    rows = [(1, y, x, *map(int, img[y, x])) for y in range(24) for x in range(40)]
    px = spark.createDataFrame(rows, "img_id long, y int, x int, r int, g int, b int")

    def grid(df):
        out = np.zeros((24, 40), int)
        for q in df.collect():
            out[q["y"], q["x"]] = q["v"]
        return out

    gray = pixels.with_gray(px)
    g = raster.gray(img)
    assert (grid(gray) == g).all()
    assert pixels.otsu_thresholds(gray).first()["threshold"] == raster.otsu_threshold(g)
    assert (grid(pixels.otsu(gray)) == raster.otsu(g)).all()
    assert (grid(pixels.adaptive(gray)) == raster.adaptive(img)).all()
    assert (grid(pixels.color_mask(px)) == raster.color_mask(img)).all()
    for a, b in ((pixels.dilate, raster.dilate), (pixels.erode, raster.erode), (pixels.close_gaps, raster.close_gaps)):
        assert (grid(a(gray)) == b(g)).all()
    assert [q["out"] for q in pixels.contrast_table(spark).orderBy("v").collect()] == raster.contrast_table().tolist()
    score = pixels.region_score(gray, (3, 2, 30, 15)).first()["score"]
    assert score == pytest.approx(raster.text_score(img, (3, 2, 30, 15)))


def test_raster_kernels():
    flat = np.full((30, 60, 3), 90, np.uint8)
    assert raster.otsu_threshold(raster.gray(flat)) == 128 and (raster.adaptive(flat) == 255).all()
    assert raster.upscale(flat).shape == (120, 240, 3) and (raster.upscale(flat) == 90).all()
    assert raster.upscale(np.zeros((2, 1300, 3), np.uint8)).shape[1] == 1300
    with pytest.raises(ValueError):
        raster.crop(flat, (100, 0, 5, 5))
    assert raster.crop(flat, (-5, -5, 10, 10)).shape == (5, 5, 3)
    assert (raster.preprocess(flat, "Invert") == 255 - raster.preprocess(flat, "Otsu")).all()
    region, confidence = raster.detect_region(flat)
    assert confidence == 0 and region == raster.padded(raster.candidates(60, 30)[0][0], 60, 30)
    assert not raster.has_subtitle(flat)


def test_recognition_over_image_files(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    for k in range(1, 5):
        img = np.zeros((20, 30, 3), np.uint8)
        img[5:10, 5 : 5 + 3 * k] = 250
        frames.save_image(img, str(folder / f"frame_{k:06d}.png"))
    shown = frames.read_frames(spark, str(tmp_path), 2)
    assert [(r["frame_no"], r["ts_ms"]) for r in shown.orderBy("ts_ms").collect()] == [(1, 0), (2, 500), (3, 1000), (4, 1500)]
    engine = FakeEngine(lambda a: (" “text” ", 80.0) if (a > 128).mean() > 0.1 else ("", 0.0))
    got = ocr.recognize(shown, engine).orderBy("ts_ms").collect()
    assert len(got) == 4 and got[-1]["text"] == '"text"'
    kept = raster.map_images(shown, lambda a: {"likely": bool(raster.has_subtitle(a))}, "video_id long, ts_ms long, likely boolean", ["video_id", "ts_ms"])
    assert kept.count() == 4


def test_frames_are_cut_by_a_program(spark, tmp_path):
    """A stand-in for ffmpeg that writes three files by the pattern it is given, or fails."""
    program, video, out = tmp_path / "ffmpeg", tmp_path / "a [1].mp4", tmp_path / "out"
    program.write_text("#!/bin/sh\nfor last; do :; done\ncase \"$*\" in *bad*) echo one >&2; echo no such stream >&2; exit 1;; esac\nfor n in 1 2 3; do : > \"$(printf \"$last\" $n)\"; done\n")
    program.chmod(0o755)
    video.write_text("x")
    (out / "7").mkdir(parents=True)
    (out / "7" / "frame_000009.png").write_text("old")
    one = spark.createDataFrame([(7, str(video))], "video_id long, path string")
    got = [(r["frame_no"], r["ts_ms"], r["path"][-16:]) for r in extract.extract_frames(one, str(out), 3, str(program)).orderBy("frame_no").collect()]
    assert got == [(1, 0, "frame_000001.png"), (2, 333, "frame_000002.png"), (3, 666, "frame_000003.png")]
    part = spark.createDataFrame([(8, str(video), 61_500, 62_000)], "video_id long, path string, start_ms long, end_ms long")
    assert [(r["frame_no"], r["ts_ms"]) for r in extract.extract_frames(part, str(out), 10, str(program)).orderBy("frame_no").collect()] == [(0, 61_500), (1, 61_600), (2, 61_700)]
    assert extract.command("f", "v", "d", 10, 61_500, 3_600_000)[:5] == ["f", "-ss", "00:01:01.500", "-to", "01:00:00.000"]
    (tmp_path / "bad.mp4").write_text("x")
    with pytest.raises(RuntimeError, match="no such stream"):
        extract.frames_of(str(tmp_path / "bad.mp4"), str(out), 2, str(program))
    with pytest.raises(FileNotFoundError):
        extract.frames_of(str(tmp_path / "none.mp4"), str(out), 2, str(program))


def test_frames_with_gaps_in_their_names(spark, tmp_path):
    for folder, numbers in (("plain", (3, 4, 5)), ("gaps", (1, 4, 9))):
        (tmp_path / folder).mkdir()
        for k in numbers:
            frames.save_image(np.full((2, 2, 3), k, np.uint8), str(tmp_path / folder / f"frame_{k:06d}.png"))
    got = Counter((r["frame_no"], r["ts_ms"], r["data"][0]) for r in frames.read_frames(spark, str(tmp_path), 2).collect())
    assert got == Counter({(1, 0, 3): 1, (2, 500, 4): 1, (3, 1000, 5): 1, (1, 0, 1): 1, (2, 500, 4): 1, (3, 1000, 9): 1} | {(2, 500, 4): 2})


def test_passes_end_with_one_that_is_good_enough(spark, tmp_path):
    """As best_pass has it, which leaves out later passes; here they aren't tried at all, so what they would read can't matter."""
    shown = spark.createDataFrame([(1, 0, bytes(12), 2, 2)], "video_id long, ts_ms long, data binary, width int, height int")
    tries = []

    def rule(_):
        tries.append(1)
        return ("good text", 100.0) if len(tries) == 1 else ("a much better text 漢字漢字漢字", 100.0)

    (r,) = ocr.recognize(shown, FakeEngine(rule)).collect()
    assert r["text"] == "good text"
    ocr.recognize(shown, FakeEngine(lambda _: ("", 0.0)), looked_at=str(tmp_path / "seen")).collect()
    assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == ["0_original_1_0.png", "1_Adaptive_1_0.png", "1_ColorBased_1_0.png", "1_Invert_1_0.png", "1_Otsu_1_0.png"]


def test_quality_agrees_in_both_forms(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("ab!?.,;:@#好に \n9") for _ in range(rnd.randint(0, 12))) for _ in range(300)] + ["", "aaaa", "!!!!", "x" * 300]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.quality_of("t").alias("q")).collect():
        assert r["q"] == pytest.approx(folds.quality(r["t"])), repr(r["t"])


def test_lines_of_an_image(spark):
    rows = [(1, 0, 0, "first", 50.0, 12.0), (1, 1, 0, "line", 50.0, 12.0), (1, 2, 1, "second", 50.0, 12.0), (2, 0, 0, None, 1.0, 1.0)]
    got = {r["line_id"]: r["text"] for r in ocr.lines(spark.createDataFrame(rows, "line_id long, pos int, row int, text string, w double, h double")).collect()}
    assert got == {1: "first line\nsecond", 2: ""}


def test_noise_ends_where_the_text_does(spark):
    kept = detection.filter_noise(cues(spark, [(0, 900, "aaa"), (0, 900, "aaa\n"), (0, 900, "a a a")]))
    assert [r["idx"] for r in kept.collect()] == [2]


def test_videos_without_cues_or_frames(spark):
    videos = spark.createDataFrame([(1,), (2,), (2,)], "video_id long")
    assert [(r["video_id"], r["error"]) for r in cleaning.validate(cues(spark, [(0, 900, "a")]), videos).collect()] == [(2, "Không có subtitle")]
    shown = spark.createDataFrame([(1, 0, True)], "video_id long, ts_ms long, has_text boolean")
    assert sorted((r["video_id"], r["fps"]) for r in timing.optimal_fps(shown, videos=videos).collect()) == [(1, 2), (2, 4)]


def test_best_pass_rules(spark):
    rows = [(1, 0, 0, "ColorBased", "good text", 100.0), (1, 0, 1, "Otsu", "good text here", 100.0), (1, 1, 0, "ColorBased", "", 0.0), (1, 1, 3, "Raw", "raw", 40.0), (1, 1, 4, "Invert", "inv", 90.0), (1, 2, 0, "Otsu", " ", 10.0), (1, 3, 0, "ColorBased", "a b", 10.0), (1, 3, 1, "Raw", "raw", 99.0)]
    got = {r["ts_ms"]: (r["mode"], r["text"]) for r in ocr.best_pass(spark.createDataFrame(rows, schema.ATTEMPTS)).collect()}
    assert got[0] == ("ColorBased", "good text") and got[1] == ("Raw", "raw") and got[2][1] == "" and got[3][1] == "a b"


def test_settings_and_files(spark):
    assert schema.language(2) == "eng" and schema.language(9) == "chi_sim"
    assert schema.preprocess_mode(3) == "ColorBased" and schema.preprocess_mode(7) == "Auto" and schema.low_fps_warning(2)
    for wrong in (lambda: schema.language(9, True), lambda: frames.checked_fps(11)):
        with pytest.raises(ValueError):
            wrong()
    assert spark.range(1).select(F.size(frames.stretch(F.lit(0), F.lit(1200))).alias("n")).first()["n"] == 13
    whole = regions.intersection(regions.rect(F.lit(-5), F.lit(0), F.lit(10), F.lit(10)), regions.rect(F.lit(0), F.lit(0), F.lit(8), F.lit(4)))
    assert tuple(spark.range(1).select(whole.alias("r")).first()["r"]) == (0, 0, 5, 4)


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], schema.SUBTITLES)
    for op in (timing.auto_fix, timing.adjust_gaps, timing.time_issues, timing.time_statistics, cleaning.clean_subtitles, cleaning.validate, cleaning.statistics, detection.merge_adjacent, detection.fix_timeline, srt.srt_strings):
        assert op(none).collect() == []
    nulls = spark.createDataFrame([(1, 1, 0, 900, None), (1, 2, 1000, 1900, "text")], schema.SUBTITLES)
    assert cleaning.clean_subtitles(nulls).count() == 1 and detection.merge_near_duplicates(nulls).count() == 2
    assert cleaning.validate(nulls).count() == 1


def test_stream_gives_the_spans_of_the_batch(spark, tmp_path):
    from captionforge.streaming.spans import stream_spans

    rnd = random.Random(8)
    rows = [(v, 250 * k, rnd.choice(["hello", "hello", "hel1o", "bye now", ""])) for v in (1, 2) for k in range(60)]
    kind = "video_id long, ts_ms long, text string, seen_at timestamp"
    stamped = spark.createDataFrame(rows, schema.OCR).withColumn("seen_at", F.timestamp_millis(F.col("ts_ms") + 1_700_000_000_000))
    source = str(tmp_path / "in")
    stamped.filter("ts_ms < 7000").coalesce(1).write.parquet(source)
    stamped.filter("ts_ms >= 7000").coalesce(1).write.mode("append").parquet(source)
    for hours in (1, 2):
        later = spark.createDataFrame([(9, hours, "")], schema.OCR).withColumn("seen_at", F.timestamp_millis(F.lit(1_700_000_000_000 + hours * 3_600_000)))
        later.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream_spans(stream).writeStream.format("memory").queryName("spans").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = Counter((r["video_id"], r["start_ms"], r["end_ms"], r["text"]) for r in spark.table("spans").collect())
    want = Counter((r["video_id"], r["start_ms"], r["end_ms"], r["text"]) for r in detection.raw_spans(spark.createDataFrame(rows, schema.OCR)).collect())
    assert got == want


def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from captionforge.plans import catalog

    con = duckdb.connect()
    for t in ("events", "documents", "lineitem", "part", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql, queries = catalog.oracle_sql(), catalog.queries()
    assert set(sql) == set(queries)
    for name, query in sorted(sql.items()):
        df = queries[name](spark, SF)
        names = sorted(df.columns)
        run = con.execute(query)
        got_names = [d[0] for d in run.description]
        rows = run.fetchall()
        assert sorted(got_names) == names, name
        order = [got_names.index(n) for n in names]
        assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in rows), name


@pytest.mark.parametrize("name", ["color_mask", "close_gaps", "adaptive_mean", "region_score", "dilate", "erode"])
def test_parts_grow_with_the_table(spark, monkeypatch, name):
    from captionforge.plans import carriers, catalog

    monkeypatch.setattr(carriers, "SHARE", 5_000, raising=False)
    query = catalog.queries()[name]
    parts = query(spark, SF).rdd.getNumPartitions()
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = Counter(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(carriers, "SHARE", 1 << 40)
    assert query(spark, SF).rdd.getNumPartitions() < parts and Counter(map(tuple, query(spark, SF).collect())) == whole


def test_lines_are_dealt_out_as_texts(spark):
    from captionforge.plans import catalog

    plan = catalog.queries()["line_confidence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")


def test_catalogue_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); assert 'auto_fix' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
