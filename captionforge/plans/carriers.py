"""Views of the driver's tables that have the operators' schemas, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a table's files that go to a task: some 300,000 rows of lineitem, a million words.
SHARE = 4_000_000
#: Blank, repeated, odd and broken-off texts; ideographs, of an old tale or not, alone or with Latin; two and three lines, marks alone; a break at the end.
TEXT = (
    "case when event_id % 17 = 0 then '' when event_id % 13 = 0 then 'aaaa' when event_id % 11 = 0 then '!!' when event_id % 7 = 0 then event_type || '...' "
    "when event_id % 197 = 0 then '修仙 宗门' when event_id % 19 = 0 then '你好' || chr(10) || event_type when event_id % 23 = 0 then '好' "
    "when event_id % 29 = 0 then event_type || ' ~ _' || event_type || chr(10) || '| ' || event_type || ' end' || chr(10) || event_type || chr(10) || 'four 0n' || chr(10) || event_type "
    "when event_id % 31 = 0 then 'aaa' || chr(10) when event_id % 37 = 0 then 'to the ' || event_type || ' and on' else event_type end"
)
DURATION = "case when event_id % 50 = 0 then 16000 when event_id % 9 = 0 then (31 * event_id) % 160 else (131 * event_id) % 2500 end"
START = "1000 * q + 700 * (q - q % 8) + 350 * (q - q % 5) + (37 * event_id) % 900"

SUBS_SQL = f"""subs AS (
  SELECT video_id, idx, start_ms, start_ms + {DURATION} AS end_ms, {TEXT} AS text
  FROM (SELECT *, {START} AS start_ms FROM (
    SELECT user_id AS video_id, event_id, event_type, CAST(rn AS INTEGER) AS idx, rn - 1 AS q
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events))))"""
FRAMES_SQL = """frames AS (
  SELECT user_id AS video_id, 250 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, rep) - 1) AS ts_ms,
    CASE WHEN event_type = 'error' OR (user_id % 7 = 0 AND event_id % 12 <> 0) THEN '' WHEN event_id % 61 = 0 THEN '你好 ' || event_type WHEN rep % 2 = 1 THEN replace(event_type, 'i', '1') ELSE event_type END AS text
  FROM (SELECT *, unnest(range(0, event_id % 5 + 1)) AS rep FROM events))"""
#: Dark images with spots of any colour, so that shares of bright pixels and edges are such as text has.
SPOT = "(l_orderkey + 3 * l_partkey) % 24 = 0"
COLOURS = {"r": "7 * l_partkey", "g": "13 * l_orderkey", "b": "(l_partkey + l_orderkey)"}
BYTES = {c: f"CASE WHEN {SPOT} THEN {e} % 256 WHEN (l_orderkey + 3 * l_partkey) % 24 = 5 THEN 230 ELSE 50 + {e} % 24 END" for c, e in COLOURS.items()}
PIXELS_SQL = f"""pixels AS (
  SELECT l_suppkey AS img_id, CAST((rn - 1) // 20 AS INTEGER) AS y, CAST((rn - 1) % 20 AS INTEGER) AS x, {', '.join(f'CAST({e} AS INTEGER) AS {c}' for c, e in BYTES.items())}
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem))"""
#: Three passes and two that stand in; of some frames no pass reads anything, of others nothing does; readings of several qualities.
READING = (
    "case when event_id % 6 = 0 and ord < 3 then ' ' when event_id % 12 = 0 and ord = 3 then '' when event_id % 18 = 0 and ord > 2 then '' when ord > 2 then 'raw ' || event_type "
    "when (event_id + ord) % 5 = 0 then '!!!!' when (event_id + ord) % 7 = 0 then '好' when (event_id + ord) % 11 = 0 then '你好世界' when (event_id + ord) % 13 = 0 then 'ab' else event_type end"
)
ATTEMPT_MODES = ("ColorBased", "Otsu", "Adaptive", "Raw", "Invert")
ATTEMPTS_SQL = f"""attempts AS (
  SELECT user_id AS video_id, event_id AS ts_ms, CAST(ord AS INTEGER) AS ord, {list(ATTEMPT_MODES)}[ord + 1] AS mode, {READING} AS text,
    CAST(event_id * (7 + 4 * ord) % 101 AS DOUBLE) AS conf
  FROM (SELECT *, unnest(range(0, 5)) AS ord FROM events))"""
WORDS_SQL = """words AS (
  SELECT line_id, CAST(pos AS INTEGER) AS pos, CAST(pos // 9 AS INTEGER) AS row, text, CAST(7 * length(text) AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h
  FROM (SELECT doc_id AS line_id, unnest(t) AS text, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS t FROM documents)))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table by key, in parts whose number grows with its files: sorts and aggregates hold all of a task's rows.

    Spark's own number is fixed, or goes by compressed bytes of an exchange, of which a task's rows take many times as much.
    """
    rows = table(spark, sf_dir, name)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // SHARE)), key)


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.row_number().over(order).alias("idx"))
    e = e.withColumn("q", F.col("idx").cast("long") - 1).withColumn("start_ms", F.expr(START)).withColumn("end_ms", F.col("start_ms") + F.expr(DURATION))
    return e.select(F.col("user_id").alias("video_id"), "idx", "start_ms", "end_ms", F.expr(TEXT).alias("text"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 5)).alias("rep"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id", "rep")) - 1
    blank = (F.col("event_type") == "error") | ((F.col("user_id") % 7 == 0) & (F.col("event_id") % 12 != 0))
    text = F.when(blank, "").when(F.col("event_id") % 61 == 0, F.concat(F.lit("你好 "), "event_type")).when(F.col("rep") % 2 == 1, F.translate("event_type", "i", "1")).otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("video_id"), (k.cast("long") * 250).alias("ts_ms"), text.alias("text"))


def frame_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("video_id", "ts_ms", (F.col("text") != "").alias("has_text"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    numbered = dealt(spark, sf_dir, "lineitem", "l_suppkey").select("l_suppkey", "l_partkey", "l_orderkey", k.alias("k"))
    return numbered.select(F.col("l_suppkey").alias("img_id"), F.expr("cast(k div 20 as int)").alias("y"), (F.col("k") % 20).alias("x"), *[F.expr(f"cast({e} as int)").alias(c) for c, e in BYTES.items()])


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.explode(F.array(*map(F.lit, range(5)))).alias("ord"))
    mode = F.element_at(F.array(*map(F.lit, ATTEMPT_MODES)), F.col("ord") + 1)
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ts_ms"), "ord", mode.alias("mode"), F.expr(READING).alias("text"), ((F.col("event_id") * (F.col("ord") * 4 + 7)) % 101).cast("double").alias("conf"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by number, most of which have no cues and no frames."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"))


def lines_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("line_id"), F.coalesce("text", F.lit("")).alias("text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"))


def words(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Words of lines; together: a line's words lie in one task, dealt out as texts, which take a fraction of their words' bytes."""
    t = F.array_remove(F.split("text", r"[ \t\n\r\f\x0B]+"), "")
    read = lines_of(dealt(spark, sf_dir, "documents", "doc_id")) if together else lines(spark, sf_dir)
    e = read.select("line_id", F.posexplode(t).alias("pos", "text"))
    return e.select("line_id", "pos", F.expr("cast(pos div 9 as int)").alias("row"), "text", (F.length("text") * 7).cast("double").alias("w"), F.lit(12.0).alias("h"))
