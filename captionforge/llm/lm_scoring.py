"""LM scoring: word counts of the training texts, a gated recurrent model learnt from all of them, log-likelihoods of whole texts.

1. Counts: every task counts the words of its training texts, the counts are added up by word and written to the shared folder.
2. The most frequent words, as many as FREQUENT at most, found by a histogram of counts (a few hundred rows), are broadcast.
3. Learning: training texts are dealt by hash to shards of about SHARD tokens, and the shards to rounds. In a round every shard is
   learnt from, beginning with the same parameters; these, of fixed size, are averaged by tokens in pieces, in a tree of groups of
   GROUP, and the next round goes on from the mean. Splits of the input have no part in it, so scores don't depend on them.
4. Scoring: every text is read once more. What is known of frequent words is added up where the text is read; its rarer words go
   to the counts in one join by word, and what they add comes back to the text in one sum. Words so rare cannot be skewed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import cut, table

#: Words broadcast with their counts at most; of these, words with parameters of their own. Classes of such words.
FREQUENT, OWN, CLASSES = 65_536, 4096, 28
#: Buckets of rarer words by their last bytes, on input and as rest classes.
ENDINGS, RESTS, TAIL = 1024, 16, 3
#: Rounds of learning and averaging; tokens of a shard; partitions that a round's shards are dealt to at most.
ROUNDS, SHARD, PARTITIONS = 4, 2_000_000, 20_000
#: Shards whose parameters are averaged at once; pieces that parameters are cut into; tokens that a worker turns over at once.
GROUP, PIECES, LEARN, SCORE = 64, 16, 4_000_000, 1_500_000
#: Words a worker counts before it hands them on.
STORE = 400_000
FOLDS, HELD = 5, 1


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def ending(word: bytes) -> int:
    return zlib.crc32(word[-TAIL:]) % ENDINGS


def counts(named: DataFrame) -> DataFrame:
    """(word, n) over the training texts; the row with word null counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in c], pa.string()), pa.array(c.values(), pa.int64())], ["word", "n"])

        c: Counter = Counter()
        ends = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(tokens(text))
                ends += 1
                if len(c) > STORE:
                    yield out(c)
                    c = Counter()
        yield out(c)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "n"])

    return named.filter(~F.col("held_out")).select("_text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def frequent(known: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, most at most, with their counts: all above a step of the histogram of counts."""
    step = F.floor(F.log2("n") * 16).cast("int")
    words = known.filter("word is not null")
    hist = sorted(((r[0], r[1]) for r in words.groupBy(step.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True)
    least, so_far = 1 << 30, 0
    for s, n in hist:
        if so_far + n > most:
            break
        least, so_far = s, so_far + n
    found = [(r["word"].encode(), r["n"]) for r in words.filter(step >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class Ids(dict):
    """Ids of frequent words; a rarer word has that of its bucket, and is not kept."""

    first: int

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-TAIL:]) % ENDINGS


class Vocabulary:
    """Ids of words, their counts, and the layout of the model over them. ends: texts counted; mass: of each rest class."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int, mass: dict[int, float], own: int):
        self.id = Ids({w: k + 1 for k, (w, _) in enumerate(top)})
        self.n_top, own = len(top), min(own, len(top))
        self.id.first = self.n_top + 1
        count = np.array([ends, *(n for _, n in top)], np.int64)
        #: by id: log10(count + 1/2); nothing for the buckets of rarer words
        self.logs = np.concatenate([np.log10(count + 0.5), np.zeros(ENDINGS)])
        self.known = np.concatenate([count > 0, np.zeros(ENDINGS, bool)])
        ends_of = np.array([0] * (own + 1) + [ending(w) for w, _ in top[own:]] + list(range(ENDINGS)))
        rest = np.array([mass.get(k, 0.0) + 0.5 for k in range(RESTS)])
        for w, n in top[:own]:
            rest[ending(w) % RESTS] -= n + 0.5
        rest = np.maximum(rest, 0.5)
        # classes of frequent words: equal shares of the sum of square roots of their counts
        weight = np.sqrt(count[: own + 1] + 0.5)
        order = np.argsort(-weight, kind="stable")
        share = np.cumsum(weight[order]) / weight.sum()
        cls = np.minimum((share * CLASSES - 1e-9).astype(int), CLASSES - 1)
        _, cls = np.unique(cls, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(np.bincount(cls))])
        within, classes = np.empty(own + 1, np.int64), np.empty(own + 1, np.int64)
        classes[order] = cls
        within[order] = np.arange(own + 1) - starts[cls]
        bias = np.log(count[order] + 0.5)
        n_cls = len(starts) - 1
        total = np.array([np.exp(bias[starts[k] : starts[k + 1]]).sum() for k in range(n_cls)])
        later = n_cls + ends_of[own + 1 :] % RESTS
        self.layout = gru.Layout(
            inputs=np.concatenate([np.arange(own + 1), own + 1 + ends_of[own + 1 :]]).astype(np.int32),
            classes=np.concatenate([classes, later]).astype(np.int32),
            within=np.concatenate([within, np.full(len(later), -1)]).astype(np.int32),
            rest=np.concatenate([np.zeros(own + 1), self.logs[own + 1 :] * np.log(10) - np.log(rest[later - n_cls])]).astype(np.float32),
            starts=starts,
            class_bias=np.log(np.concatenate([total, rest])) - np.log(total.sum() + rest.sum()),
            word_bias=bias,
            n_inputs=own + 1 + ENDINGS,
        )

    def ids(self, text: str, rare: bool = True) -> tuple[np.ndarray, list[bytes]]:
        """The ids of a text's tokens, the end included, and, if asked for, its rarer words."""
        words = tokens(text)
        out = np.zeros(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.id.__getitem__, words), np.int32, len(words))
        return out, [words[k] for k in np.flatnonzero(out > self.n_top).tolist()] if rare else []


def mean(t: pa.Table, up: int) -> pa.Table:
    """Of rows (at, piece, n, data) of one piece the mean by n, in the order of at; it goes on as number at // up."""
    order = np.argsort(t["at"].to_numpy(), kind="stable")
    n, data = t["n"].to_numpy(), t["data"].to_pylist()
    total = sum(np.frombuffer(data[k], np.float32) * float(n[k]) for k in order) / n.sum()
    return pa.table({"at": pa.array([t["at"][0].as_py() // up], pa.int64()), "piece": t["piece"][:1].combine_chunks(), "n": pa.array([n.sum()], pa.int64()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def learnt_round(texts: DataFrame, shards: int, vocabulary: Vocabulary, p: gru.Params) -> gru.Params:
    """Of rows (at, _h, _text) the texts of each number at are learnt from in the order of _h, beginning with p; the mean by tokens."""
    names, sent = list(p), texts.sparkSession.sparkContext.broadcast((vocabulary, p))
    dealt = texts.repartitionById(min(shards, PARTITIONS), F.col("at").cast("int") % min(shards, PARTITIONS)).sortWithinPartitions("at", "_h", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = sent.value

        def out(at: int, learner: gru.Learner, held: list[np.ndarray]) -> pa.RecordBatch:
            learner.learn(held)
            pieces = np.array_split(np.concatenate([learner.p[k].ravel() for k in names]), PIECES)
            return pa.RecordBatch.from_arrays([pa.array([at] * PIECES, pa.int64()), pa.array(range(PIECES), pa.int64()), pa.array([learner.tokens] * PIECES, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in pieces], pa.binary())], ["at", "piece", "n", "data"])

        now, learner, held, n = None, None, [], 0
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if learner:
                        yield out(now, learner, held)
                    now, learner, held, n = at, gru.Learner(p, vocabulary.layout), [], 0
                held.append(vocabulary.ids(text, rare=False)[0])
                n += len(held[-1])
                if n >= LEARN:
                    learner.learn(held)
                    held, n = [], 0
        if learner:
            yield out(now, learner, held)

    schema = "at long, piece long, n long, data binary"
    each, groups = dealt.select("at", "_text").mapInArrow(run, schema), shards
    while True:
        each = each.groupBy(F.expr(f"at div {GROUP}"), "piece").applyInArrow(lambda t: mean(t, GROUP), schema)
        groups = -(-groups // GROUP)
        if groups == 1:
            break
    means = each.orderBy("piece").collect()
    if not means:
        return p
    flat, out, at = np.concatenate([np.frombuffer(r["data"], np.float32) for r in means]), {}, 0
    for k in names:
        out[k] = flat[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    return out


def learnt(named: DataFrame, vocabulary: Vocabulary, tokens: int, shard: int = SHARD, rounds: int = ROUNDS) -> gru.Params:
    """The parameters, learnt from all training texts in rounds; each goes on from the mean of the one before.

    A text's shard, and with it its round and its place there, follow from its id and text and the number of tokens alone: how rows
    are split makes no difference. A shard has about `shard` tokens.
    """
    each = max(1, -(-tokens // (rounds * shard)))
    hashed = named.filter(~F.col("held_out")).withColumn("_h", F.xxhash64("doc_id", "_text"))
    placed = hashed.select(F.pmod("_h", F.lit(rounds * each)).alias("_shard"), "_h", "_text")
    p = gru.fresh(vocabulary.layout)
    for r in range(rounds):
        own = placed.filter(F.col("_shard") % rounds == r).select(F.expr(f"_shard div {rounds}").alias("at"), "_h", "_text")
        p = learnt_round(own, each, vocabulary, p)
    return p


def listed(rare: list[Counter]) -> pa.Array:
    """Each counter as a list of (word, n), put together flat and not entry by entry."""
    ends, words = np.cumsum([0, *map(len, rare)]), pa.array(list(chain.from_iterable(rare)), pa.binary())
    n = np.fromiter(chain.from_iterable(c.values() for c in rare), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"]))


def scored(named: DataFrame, vocabulary: Vocabulary, p: gru.Params) -> DataFrame:
    """Per text what its frequent words, and the classes of all, add to either score; and its rarer words."""
    sent = named.sparkSession.sparkContext.broadcast((vocabulary, p))
    rare = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([named.schema["doc_id"], named.schema["held_out"], *[T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("model", T.DoubleType()), ("rare", rare))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, p = sent.value

        def out(held: list[tuple]) -> pa.RecordBatch:
            doc, fold, ids, known, logs, rare = map(list, zip(*held, strict=True))
            model = gru.score(p, vocabulary.layout, ids) / np.log(10)
            columns = [pa.array(doc, kinds[0]), pa.array(fold, pa.bool_()), pa.array(list(map(len, ids)), pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(model, pa.float64()), listed(rare)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        held, n, kinds = [], 0, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type]
            for doc, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, others = vocabulary.ids(text)
                held.append((doc, fold, ids, int(vocabulary.known[ids].sum()), float(vocabulary.logs[ids].sum()), Counter(others)))
                n += len(ids)
                if n >= SCORE:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return named.select("doc_id", "held_out", "_text").mapInArrow(run, schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = FREQUENT, own: int = OWN, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) for each row of docs.

    Null counts as empty; such a text is scored for its end alone. A null id counts as empty in the choice of the fold. Rows are
    scored one by one, so repeated rows have one score, and each counts in training. Without training rows every count is zero and
    the model is as it begins. Words that tie in count are ordered by code point. Without rows the result is empty. Other
    columns are ignored. Scores are the same, up to rounding, however rows are stored and split.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = cut(counts(named))
    row = known.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    total, distinct, ends = row[0] or 0, row[1], row[2] or 0
    last = F.crc32(F.expr(f"substring(cast(word as binary), -{TAIL}, {TAIL})")) % ENDINGS % RESTS
    mass = {r[0]: float(r[1]) for r in known.filter("word is not null").groupBy(last.alias("c")).agg(F.sum(F.col("n") + 0.5)).collect()}
    vocabulary = Vocabulary(frequent(known, most_frequent), ends, mass, own)
    p = learnt(named, vocabulary, total, shard)
    rows = cut(scored(named, vocabulary, p).withColumn("_row", F.monotonically_increasing_id()))

    others = rows.select("_row", F.explode("rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("_k"))
    least = vocabulary_least(vocabulary, most_frequent)
    counted = others.join(known.filter("word is not null").filter(F.col("n") <= least), "word", "left")
    c = F.coalesce("n", F.lit(0))
    added = counted.groupBy("_row").agg(F.sum(F.col("_k") * F.log10(c + 0.5)).alias("_logs"), F.sum(F.when(c > 0, F.col("_k")).otherwise(0)).alias("_known"))
    met = rows.drop("rare").join(added, "_row", "left").withColumn("_logs", F.coalesce("_logs", F.lit(0.0))).withColumn("_known", F.coalesce("_known", F.lit(0)))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return met.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("_logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + F.col("_logs")).alias("score"),
    )


def vocabulary_least(vocabulary: Vocabulary, most: int) -> int:
    """No word that isn't broadcast has a greater count."""
    return int(round(10 ** vocabulary.logs[vocabulary.n_top] - 0.5)) if vocabulary.n_top else 1 << 62


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
