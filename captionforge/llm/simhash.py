"""SimHash near-deduplication by covering locality-sensitive hashing.

Fingerprints at 3 or fewer differing bits are linked. Every bit has a nonzero vector of 4 bits, and each of the 15 nonzero
vectors v is a table whose mask holds the bits whose vector has an odd product with v. Three vectors never span the space of
four, so for any three bits some v has an even product with all: its mask leaves them out, and the pair collides in that table.
No link is lost, whatever the fingerprints.

Equal fingerprints are one before anything is paired. First every member of a bucket is linked with the bucket's least and largest
fingerprint, if these are within the radius: two edges a member, and the components of these take in nearly all of a group of near copies.
What is left are buckets whose members are in several components. One of at most `most` fingerprints is joined with itself, for pairs from
different components only. Those in larger ones are linked another exact way, without pairs: each goes to all points within 2 bits, and a point that has one
within 1 bit ties all others there to it (1 + 2 bits are 3 at most; of a linked pair, some point is within 1 of one and 2 of
the other). That is 2081 rows a fingerprint, however large its bucket.

near_duplicates has one fingerprint a text. keep_near, which is to catch texts that share most of their five-word shingles, takes
several, each with random bits of its own, over shorter shingles, of which an edit touches fewer: texts within the radius by any of them
are linked. Every fingerprint has covering tables of its own, so no such link is lost either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keyed, table
from .components import stars

RADIUS, SEED, SHINGLE, BITS = 3, 42, 3, 64
#: Rows a worker turns over at once, and fingerprints of the largest bucket that is joined with itself: in all tables together one meets
#: 15 x 256 / 2 others at most then, which is about what its 2081 points cost.
ROWS, MOST = 500, 256
#: Shingles whose bits are counted at once.
TURN = 20_000
#: Words of a shingle and fingerprints of a text, where near copies are to be caught.
NEAR_SHINGLE, PRINTS = 2, 8


def masks() -> list[int]:
    """The 15 masks, as signed 64-bit integers."""
    vector = [(i % 15) + 1 for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, 1 << (RADIUS + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def hashes(text: str, shingle: int) -> np.ndarray | None:
    """XXH64 of the text's shingles, repeats included; of a shorter text the whole; None without words."""
    w = text.encode().lower().split()
    if not w:
        return None
    h = xxhash.xxh64_intdigest
    every = zip(*(w[k:] for k in range(shingle)), strict=False) if len(w) >= shingle else [w]
    return np.array([h(b" ".join(t), SEED) for t in every], dtype="<u8")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other random bits for the same hashes, the k-th (splitmix64's finish); those of 0 are the hashes."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """A bit is set if it is in over half the shingles' hashes; without words none is."""
    h = hashes(text, shingle)
    if h is None:
        return [0] * prints
    counts = np.zeros(prints * BITS, np.int64)
    for at in range(0, len(h), TURN):
        part = np.stack([mixed(h[at : at + TURN], k) for k in range(prints)], axis=1)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8").tolist()


def fingerprints(named: DataFrame, shingle: int = SHINGLE, prints: int = 1) -> DataFrame:
    """named with _fps, the fingerprints as signed 64-bit integers, in place of its last column, the text (null for empty)."""
    others = named.columns[:-1]
    whole = named.withColumn(named.columns[-1], F.coalesce(F.col(named.columns[-1]), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = np.array([fingerprint(t, shingle, prints) for t in batch.columns[-1].to_pylist()], dtype=np.uint64).view(np.int64)
                fps = pa.ListArray.from_arrays(pa.array(range(0, found.size + 1, prints), pa.int32()), pa.array(found.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*others, "_fps"])

    return whole.mapInArrow(run, T.StructType([*(named.schema[c] for c in others), T.StructField("_fps", T.ArrayType(T.LongType()))]))


def apart(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right, both dealt out by key whatever their sizes: no table that grows with the documents is sent through the driver."""
    return left.join(right.hint("merge"), on, how)


def buckets(distinct: DataFrame) -> DataFrame:
    """(v, key, n, _k, _fp, _m, lo, hi): every fingerprint in each bucket of n > 1 that it is in.

    lo and hi are the nodes of the bucket's hubs, its least and largest fingerprint, where these are within the radius; else null.
    """
    tables = F.array(*[F.struct(F.lit(n).alias("v"), F.lit(m).alias("m")) for n, m in enumerate(masks())])
    dealt = distinct.select("_k", "_fp", "_m", F.explode(tables).alias("t")).select("_fp", "_m", (F.col("_k") * len(masks()) + F.col("t.v")).alias("v"), F.col("_fp").bitwiseAND(F.col("t.m")).alias("key"))
    node = F.struct("_fp", "_m")
    shared = cut(dealt.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min(node).alias("_lo"), F.max(node).alias("_hi")).filter("n > 1"))
    hub = lambda c: F.when(F.bit_count(F.col("_fp").bitwiseXOR(F.col(f"{c}._fp"))) <= RADIUS, F.col(f"{c}._m"))
    return cut(apart(dealt, shared, ["v", "key"]).select("v", "key", "n", F.expr(f"v div {len(masks())}").alias("_k"), "_fp", "_m", hub("_lo").alias("lo"), hub("_hi").alias("hi")))


def hubs(met: DataFrame) -> DataFrame:
    """(a, b): the edges of a bucket's members with its hubs, two a member however large the bucket."""
    return met.select(F.col("_m").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter("a <> b").distinct()


def rest(met: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(a, b): edges that tie together what lies within the radius and isn't in one component of roots (node, root) yet."""
    # of up to three members each pair has a hub in it; a bucket whose members are all in one component has nothing left to tie
    rooted = apart(met.filter("n > 3").drop("lo", "hi"), roots, F.col("_m") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_m")).drop("node")
    mixed = rooted.groupBy("v", "key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("v", "key")
    left = cut(apart(rooted, mixed, ["v", "key"], "left_semi"))
    few = left.filter(F.col("n") <= most).select("v", "key", "_fp", "_m", "root")
    pairs = (
        apart(few.withColumnsRenamed({"_fp": "x", "_m": "a", "root": "_a"}), few.withColumnsRenamed({"_fp": "y", "_m": "b", "root": "_b"}), ["v", "key"])
        .filter((F.col("x") < F.col("y")) & (F.col("_a") != F.col("_b")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS))
        .select("a", "b")
        .distinct()
    )
    many = left.filter(F.col("n") > most).select("_k", "_fp", "_m").distinct()
    # bits 0 to 63; 64 stands for none, so (64, 64) is the fingerprint itself and (i, 64) one bit away
    flip = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, {c})")).otherwise(F.lit(0).cast("long"))
    ball = many.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64)))).withColumn("j", F.explode(F.expr("if(i = 64, array(64), sequence(i + 1, 64))")))
    ball = ball.select("_k", "_m", F.col("_fp").bitwiseXOR(flip("i")).bitwiseXOR(flip("j")).alias("z"), (F.col("j") == 64).alias("near"))
    centre = ball.groupBy("_k", "z").agg(F.min(F.when(F.col("near"), F.col("_m"))).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1 and b is not null")
    tied = apart(ball, centre, ["_k", "z"]).filter("_m <> b").select(F.col("_m").alias("a"), "b").distinct()
    return pairs.unionByName(tied)


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): edges that tie together exactly what lies within the radius.

    distinct has the fingerprints (_k, _fp), _k telling one kind from another, and the node _m that each stands for; edges are of nodes.
    """
    met = buckets(distinct)
    first = cut(hubs(met))
    return first.unionByName(rest(met, cut(stars(first)), most))


def rooted(found: DataFrame, best: str, most: int) -> DataFrame:
    """(_fp, _rep, _root): for each first fingerprint of found (columns `best` and _fps) its least `best`, and what names its component.

    Texts that have any fingerprint in common are one component to begin with, which goes by the least first fingerprint.
    """
    reps = cut(found.groupBy(F.get("_fps", F.lit(0)).alias("_fp")).agg(F.min(best).alias("_rep")))
    kinds = found.select("_fps").distinct().select(F.get("_fps", F.lit(0)).alias("_first"), F.posexplode("_fps").alias("_k", "_fp"))
    nodes = cut(kinds.groupBy("_k", "_fp").agg(F.min("_first").alias("_m"), F.max("_first").alias("_n")))
    common = apart(kinds, nodes.filter("_m <> _n").drop("_n"), ["_k", "_fp"]).filter("_first <> _m").select(F.col("_first").alias("a"), F.col("_m").alias("b"))
    met = buckets(nodes.drop("_n"))
    first = cut(stars(hubs(met).unionByName(common)))
    # what the hubs have tied goes on as one edge a node
    roots = stars(first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest(met, first, most)))
    return apart(reps, roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_rep", F.coalesce("root", "_fp").alias("_root"))


def components(found: DataFrame, best: str, most: int) -> DataFrame:
    """(_fp, _least): for each first fingerprint of found (columns `best` and _fps) the least `best` of its component."""
    named = rooted(found, best, most)
    return apart(named, named.groupBy("_root").agg(F.min("_rep").alias("_least")), "_root").select("_fp", "_least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id reachable over links, itself included) for each row of docs.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Null ids have a component but
    name it only if all ids in it are null. Repeated rows and ties have one fingerprint and so one component. No rows, no result.
    Other columns are ignored.
    """
    found = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))))
    named = components(found, "doc_id", most)
    return apart(found.withColumn("_fp", F.get("_fps", F.lit(0))), named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_least").alias("component_id"))


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, prints: int = PRINTS, most: int = MOST) -> DataFrame:
    """One row of each component, with the columns it came with.

    A text has `prints` fingerprints over shingles of `shingle` words, and is linked with those within the radius by any of them. With 3
    and 1 links and components are near_duplicates'; null texts are empty, and texts without words are linked like any other. Of a component the row with the least id stays; one of a null id stays
    only if all ids are null. Rows are told apart by where they are read (common.keyed), so of rows that tie in id, repeated rows and
    rows of null ids too, exactly one stays. Columns of any name pass through; no rows give none.
    """
    rows = keyed(docs)
    found = cut(fingerprints(rows.select(F.struct(F.col("row")[id_col].isNull().alias("null"), F.col("row")[id_col].alias("id"), "key").alias("_best"), F.col("row")[text_col].alias("_text")), shingle, prints))
    kept = rooted(found, "_best", most).groupBy("_root").agg(F.min("_rep").alias("_least")).select("_least.key")
    return apart(rows, kept, "key", "left_semi").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
