"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in the order of a hash of their ids and texts, form a line of tokens that is cut into blocks of equal length.
A schedule of slots says which source comes when: slot k's van der Corput point falls into a source's stretch of the cumulative
slot shares. Slots are ranked per source; the slot of rank j takes block j of the shuffled line, from its start again once all
blocks are taken. The schedule is low-discrepancy, so every stretch of it holds the sources in nearly their shares.

Nothing is counted over a whole source in one task: ranks and token offsets are counted within chunks of the schedule or hash
buckets of the source, whose totals are then added up. Only per-source totals are in one place (one row per source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, keyed, table, words

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its own size.
MOST = 3
#: Blocks a source's target is cut into at least, and the longest block.
BLOCKS, LONGEST = 256, 4096
BUCKET_BITS, CHUNK, POINT_BITS, GRID = 12, 4096, 40, 1024


def sizes(named: DataFrame) -> DataFrame:
    """Of rows (doc_id, key, _text, _source): doc_id, key, _source, size, the words of the text, none for null, and _h, a hash of id and text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    return named.select("doc_id", "key", "_source", F.size(words(text)).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("_h"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: _sid (rank by code point, null last), _source, source_size, target, and the block layout.

    Water-filling in one pass: in the order of (MOST x size) / weight, a source is full if what is left, shared by weight
    among it and the later ones, exceeds its limit; the level of the others is that of the first which isn't full.
    """
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    per = per.withColumn("_sid", F.row_number().over(every))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("_sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("long")
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * MOST)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy((F.col("_cap") / F.col("_w")), "_sid").rowsBetween(Window.unboundedPreceding, 0)
    left = (F.sum("source_size").over(whole) - F.sum("_cap").over(upto) + F.col("_cap")).cast("double")
    per = per.withColumn("_level", left / (F.sum("_w").over(whole) - F.sum("_w").over(upto) + F.col("_w")))
    full = F.col("_cap") <= F.col("_level") * F.col("_w")
    per = per.withColumn("_final", F.max("_level").over(whole))
    target = F.when(full, F.col("_cap").cast("double")).otherwise(F.least(F.col("_final") * F.col("_w"), F.col("_cap").cast("double")))
    per = per.withColumn("target", target).withColumn("_take", F.least(F.floor(F.col("target") + 0.5), F.col("_cap")))
    per = per.withColumn("_b", F.greatest(F.lit(1), F.least(F.lit(LONGEST), F.floor(F.col("_take") / BLOCKS))).cast("long"))
    some = F.col("source_size") > 0
    per = per.withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_b")))
    per = per.withColumn("_passes", F.when(some, F.expr("_take div source_size")).otherwise(F.lit(0).cast("long")))
    per = per.withColumn("_rest", F.when(some, F.expr("_take % source_size")).otherwise(F.lit(0).cast("long")))
    return per.withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / F.col("_b"))).drop("_w", "_cap", "_level", "_final")


def schedule(spark: SparkSession, per: DataFrame) -> DataFrame:
    """The slots in order: _slot, _sid, _rank (among the source's slots).

    A source that the points gave more slots than its target needs leaves the last ones; one they gave fewer gets the rest at
    the end. Both differ by the sequence's discrepancy only, a few slots in any number.
    """
    n = per.agg(F.sum("_slots")).first()[0] or 0
    upto = Window.orderBy("_sid").rowsBetween(Window.unboundedPreceding, 0)
    spans = per.filter("_slots > 0").select("_sid", "_slots", (F.sum("_slots").over(upto) - F.col("_slots")).alias("_lo"))
    spans = spans.withColumn("_hi", F.col("_lo") + F.col("_slots"))
    grid = spans.withColumn("_g", F.explode(F.expr(f"sequence(_lo * {GRID} div {max(n, 1)}, (_hi - 1) * {GRID} div {max(n, 1)})")))
    # bit reversal of the slot number: the van der Corput sequence in base 2, exact up to 2**40 slots
    point = F.conv(F.reverse(F.lpad(F.bin("_slot"), POINT_BITS, "0")), 2, 10).cast("long")
    at = F.floor(point / float(1 << POINT_BITS) * F.lit(n)).cast("long")
    slots = spark.range(n).withColumnRenamed("id", "_slot").withColumn("_at", F.least(at, F.lit(max(n - 1, 0))))
    slots = slots.withColumn("_g", F.expr(f"_at * {GRID} div {max(n, 1)}"))
    drawn = slots.join(grid, (slots["_g"] == grid["_g"]) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).select("_slot", "_sid", F.expr(f"_slot div {CHUNK}").alias("_chunk"))

    counts = drawn.groupBy("_sid", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    within = F.row_number().over(Window.partitionBy("_sid", "_chunk").orderBy("_slot"))
    ranked = drawn.withColumn("_in", within).join(offsets, ["_sid", "_chunk"]).select("_slot", "_sid", (F.col("_before") + F.col("_in") - 1).alias("_rank"))
    ranked = ranked.join(per.select("_sid", "_slots"), "_sid").filter("_rank < _slots").drop("_slots")
    got = counts.groupBy("_sid").agg(F.sum("_n").alias("_got"))
    missing = per.join(got, "_sid", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < _slots")
    missing = missing.select("_sid", F.explode(F.expr("sequence(_got, _slots - 1)")).alias("_rank")).select((F.col("_rank") + n).alias("_slot"), "_sid", "_rank")
    return ranked.unionByName(missing)


def lines(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Every row with its stretch [_start, _start + size) of its source's line of tokens; (_sid, _bucket, _place) names a row.

    The order is that of a hash of id and text, so it doesn't depend on how rows are stored, and rows of one id, or of none, are in
    many buckets.
    """
    hashed = sized.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - BUCKET_BITS))
    known = hashed.join(per, hashed["_source"].eqNullSafe(per["_source"])).drop(hashed["_source"]).drop(per["_source"])
    totals = known.groupBy("_sid", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    order = Window.partitionBy("_sid", "_bucket").orderBy("_h", "doc_id", "size", "key")
    known = known.withColumn("_place", F.row_number().over(order)).withColumn("_in", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return known.join(totals, ["_sid", "_bucket"]).withColumn("_start", F.col("_before") + F.col("_in"))


def taken(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, key, size, source_size, target, taken, and _slot, the first slot that takes of it, for each of rows (row, key)."""
    spark = rows.sparkSession
    sized = cut(sizes(rows.select(*[F.col("row")[c].alias(n) for c, n in ((id_col, "doc_id"), (text_col, "_text"), (source_col, "_source"))], "key")))
    per = cut(targets(sized))
    slots = schedule(spark, per).join(per.select("_sid", "_b", "_blocks", "_passes", "_rest"), "_sid")
    slots = slots.withColumn("_block", F.col("_rank") % F.col("_blocks")).withColumn("_pass", F.expr("_rank div _blocks"))
    end = F.when(F.col("_pass") < F.col("_passes"), (F.col("_block") + 1) * F.col("_b")).otherwise(F.least((F.col("_block") + 1) * F.col("_b"), F.col("_rest")))
    slots = slots.select("_sid", "_block", "_slot", end.alias("_end"))

    stretches = lines(sized, per)
    keep = ["_sid", "_bucket", "_place", "doc_id", "key", "size", "source_size", "target"]
    last = F.col("_start") + F.greatest(F.col("size") - 1, F.lit(0))
    pieces = stretches.withColumn("_last", last).select(*keep, "_start", "_b", F.explode(F.expr("sequence(_start div _b, _last div _b)")).alias("_block"))
    part = F.least(F.col("_start") + F.col("size"), F.col("_end")) - F.greatest(F.col("_start"), F.col("_block") * F.col("_b"))
    # least() passes over nulls, so a block that no slot takes is told apart first
    met = pieces.join(slots, ["_sid", "_block"], "left").withColumn("_part", F.when(F.col("_end").isNull(), 0).otherwise(F.greatest(part, F.lit(0))))
    return met.groupBy(*keep).agg(F.sum("_part").alias("taken"), F.min(F.when(F.col("_part") > 0, F.col("_slot"))).alias("_slot")).drop("_sid", "_bucket", "_place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, slot for each row of docs.

    Sources weigh 5, 2, 1, repeating, by code point, null last; the targets share the sum of all sizes and stop at three times
    a source's size. taken counts the words the schedule takes from the row, repeats included, never above three times its size;
    a source's sum is its target rounded. slot is the first one that takes of the row (null if none does): in its order the sources
    come in nearly their shares. Rows without words (null or empty text) take 0. Repeated rows are rows of their own, and so are
    those of one id or of none; rows that tie in id and text are interchangeable. Without rows the result is empty. Other columns
    are ignored. Reruns agree, however the rows are stored and split.
    """
    return taken(keyed(docs), id_col, text_col, source_col).withColumnRenamed("_slot", "slot").drop("key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken whole, and once more with its first words where a part is left.

    A part is the row's first words, one space between them, and its n_chars, if docs has it, is counted anew. Rows of which
    nothing is taken go, those without words too. Every row gives what mix says of it, also where an id names several rows or is
    null. Columns of any name pass through; no rows give none.
    """
    rows = keyed(docs)
    shares = taken(rows, id_col, text_col, source_col).filter("taken > 0").select("key", "size", "taken")
    met = rows.join(shares, "key").withColumn("copy", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    part = F.array_join(F.slice(words(F.col("row")[text_col]), F.lit(1), left.cast("int")), " ")
    out = met.select("row", F.when(left < F.col("size"), part).alias("part"))
    columns = {text_col: F.coalesce("part", F.col("row")[text_col])}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("part").isNotNull(), F.length("part").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return out.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
