"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Here the model is small enough to be broadcast; that of all trusted texts, which the query has, is in kneser_ney_shards. The model's tables
come from joins of n-gram counts, sharded by key: counts with their contexts' totals, then each order with the one below; keys that very
many n-grams share are joined apart.

A word that the model doesn't know is spelled: p(unknown | context) times its bytes' bigram probabilities. Every document is scored
whole. The threshold of a language is the median of its documents' log-perplexities plus FENCE times a spread, which is the distance from
the lower quartile to the median and, in quadrature, what the mean of so many tokens varies by. What is above the median has no part in
it, so up to half of a language may be junk, no fixed share is rejected, and a language without bad documents loses none but outliers.
Documents that the model was fitted on are less of a surprise to it than others, so quantiles are taken over those it wasn't. The spread
of few documents is drawn towards USUAL, the more the fewer they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, words

#: Texts of a sample at most, and words in them together; the longest one has a sixteenth of these. Times a word must be found to be known.
TRUSTED, WORDS, KNOWN = 2048, 2_000_000, 2
#: Spreads above the median (four and a half quartile distances are three standard deviations, where a distribution is normal); standard deviation
#: of a token's log10 p; spread of a language of which nothing is known, and documents that it counts for; steps of log10 p that
#: quantiles are told by.
FENCE, TOKEN, USUAL, PRIOR, STEP = 4.5, 2.0, 0.5, 16, 1000
#: N-grams of one key that are joined in one place at most.
HOT = 1024
#: Bits of a word's number in an n-gram's key. Numbers: the unknown word, the start and the end of a text, then words.
BITS, UNKNOWN, START, END, FIRST = 20, 0, 1, 2, 3
#: Tokens that a worker turns over at once, and thresholds that are broadcast at most.
TURN, BROADCAST = 400_000, 4096


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return UNKNOWN


@dataclass
class Model:
    numbers: Numbers
    #: sorted keys of the trigrams seen and log10 p; the same of bigrams, with log10 of what is left to the order below after them
    tri: np.ndarray
    tri_p: np.ndarray
    bi: np.ndarray
    bi_p: np.ndarray
    bi_left: np.ndarray
    uni_p: np.ndarray
    uni_left: np.ndarray
    #: log10 p(byte | byte before) of words' spelling; 32 stands before the first byte and after the last
    spelling: np.ndarray

    def numbered(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words) + 3, np.int64)
        out[:2], out[-1] = START, END
        out[2:-1] = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return out

    def spelled(self, words: list[bytes]) -> float:
        """log10 p of the words' spelling, all together."""
        return spelled(self.spelling, words)

    def logs(self, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 p of every number of n but the two that begin each text; starts: where texts begin."""
        own = np.ones(len(n), bool)
        own[starts] = own[starts + 1] = False
        at = np.flatnonzero(own)
        a, b, c = n[at - 2], n[at - 1], n[at]
        bc, ab = b << BITS | c, a << BITS | b
        tri, has_tri = find(self.tri, a << 2 * BITS | bc)
        two, has_two = find(self.bi, bc)
        context, has_context = find(self.bi, ab)
        lower = np.where(has_two, self.bi_p[two], self.uni_left[b] + self.uni_p[c])
        return np.where(has_tri, self.tri_p[tri], lower + np.where(has_context, self.bi_left[context], 0))


def spelled(spelling: np.ndarray, words: list[bytes]) -> float:
    if not words:
        return 0.0
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    return float(spelling[b[:-1], b[1:]].sum())


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def trusted_sample(docs: DataFrame, labels: DataFrame, most: int = TRUSTED, most_words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of at most `most` documents, with `most_words` words, that the labels call good and not toxic, by the hash of their id.

    The query counts all such texts and has no sample.
    """
    good = labels.filter("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_good")).distinct()
    chosen = good.orderBy(F.xxhash64("_good"), "_good").limit(most)
    texts = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_good")).groupBy("_good").agg(F.max(text_col).alias("text"))
    sized = texts.withColumn("_n", F.size(words(F.coalesce("text", F.lit(""))))).filter(F.col("_n") <= most_words // 16)
    # at most `most` rows
    upto = Window.orderBy(F.xxhash64("_good"), "_good").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("_upto", F.sum("_n").over(upto)).filter(F.col("_upto") <= most_words).select(F.col("_good").alias("doc_id"), "text")


def discounts(of: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of n-grams found once to four times; plain ones where these are too few to tell."""
    if min(of) == 0:
        return [0.5, 0.75, 0.9]
    y = of[0] / (of[0] + 2 * of[1])
    return [min(max(k + 1 - (k + 2) * y * of[k + 1] / of[k], 0.1), k + 0.9) for k in range(3)]


def apart(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """left joined with right by key. right has a row for each key, and in `size` how many rows of left have it.

    Keys of more than HOT rows are joined by broadcast: there are a HOT-th of left's rows of them at most, and left is bounded.
    """
    hot, rest = right.filter(F.col(size) > HOT), right.filter(F.col(size) <= HOT)
    many = left.join(F.broadcast(hot), key)
    few = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return many.unionByName(few)


def discounting(counts: DataFrame) -> Column:
    """What is taken from a count n."""
    found = {r[0]: r[1] for r in counts.filter("n <= 4").groupBy("n").count().collect()}
    d = discounts([found.get(k, 0) for k in (1, 2, 3, 4)])
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def discounted(counts: DataFrame, context: str, lower: DataFrame, lower_key: str) -> tuple[DataFrame, DataFrame]:
    """Of counts (key, n): (key, n, p) interpolated with the order below, and (_c, left), what a context leaves to it.

    The counts are joined with their contexts' totals and with the lower order's (key, n, p), each join sharded by its key.
    """
    whole = counts.withColumn("_c", F.expr(context)).withColumn("_less", discounting(counts))
    totals = cut(whole.groupBy("_c").agg((F.sum("_less") / F.sum("n")).alias("left"), F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_size")))
    met = apart(whole, totals, "_c", "_size").drop("_size").withColumn("_l", F.expr(lower_key))
    # the count of an n-gram of the lower order is the number of those that it ends
    met = apart(met, lower.select(F.col("key").alias("_l"), F.col("p").alias("_below"), F.col("n").alias("_size")), "_l", "_size")
    return met.select("key", "n", ((F.col("n") - F.col("_less")) / F.col("_total") + F.col("left") * F.col("_below")).alias("p")), totals.select("_c", "left")


def unigrams(counts: DataFrame, floor: float) -> tuple[DataFrame, float]:
    """(key, n, p) of the lowest order, interpolated with `floor` for every word, and what is left to that. One sum stands for all."""
    less = discounting(counts)
    total, taken = counts.agg(F.sum("n"), F.sum(less)).first()
    left = taken / total if total else 1.0
    return counts.select("key", "n", ((F.col("n") - less) / F.lit(float(total or 1)) + F.lit(left * floor)).alias("p")), left


def fit(trusted: DataFrame, known: int = KNOWN) -> Model:
    """The model of the texts in column text. Null counts as empty. Without any text all words are unknown, each as likely."""
    spark = trusted.sparkSession
    texts = cut(trusted.select(F.coalesce("text", F.lit("")).alias("text")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(tokens(text), pa.binary())], ["word"])

    counted = cut(texts.mapInArrow(words_of, "word binary").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    found = counted.filter(F.col("n") >= known).toArrow()
    # the most frequent ones, if there are more than keys can tell apart
    order = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))[: (1 << BITS) - FIRST - 1]
    numbers = Numbers({w: k + FIRST for k, (w, _) in enumerate(order)})
    model = Model(numbers, *[np.zeros(0)] * 7, spelling=spelling(counted))
    sent = spark.sparkContext.broadcast(model)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n = sent.value.numbered(tokens(text))
                yield pa.RecordBatch.from_arrays([pa.array(n[:-2] << 2 * BITS | n[1:-1] << BITS | n[2:], pa.int64())], ["key"])

    # the highest order counts n-grams, the others the different words before them
    low = (1 << BITS) - 1
    tri = cut(texts.mapInArrow(keys_of, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    bi = cut(tri.groupBy(F.expr(f"key & {low << BITS | low}").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    uni = cut(bi.groupBy(F.expr(f"key & {low}").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    floor = 1.0 / (len(numbers) + 2)
    p1, left0 = unigrams(uni, floor)
    p1 = cut(p1)
    p2, left1 = discounted(bi, f"shiftright(key, {BITS})", p1, f"key & {low}")
    p2 = cut(p2)
    p3, left2 = discounted(tri, f"shiftright(key, {BITS})", p2, f"key & {low << BITS | low}")

    size = len(numbers) + FIRST
    uni_p = np.full(size, np.log10(floor * left0))
    uni_left = np.zeros(size)
    for df, out, key, value in ((p1, uni_p, "key", "p"), (left1, uni_left, "_c", "left")):
        got = df.toArrow()
        out[got[key].to_numpy()] = np.log10(got[value].to_numpy())
    two = p2.drop("n").join(left2.withColumnRenamed("_c", "key"), "key", "full").toArrow().sort_by("key")
    # a context that begins a text was never counted as a bigram: only what it leaves is asked for
    two_p, two_left, two_keys = two["p"].to_numpy().copy(), two["left"].to_numpy(), two["key"].to_numpy()
    missing = np.isnan(two_p)
    two_p[missing] = 10 ** (uni_left[two_keys[missing] >> BITS] + uni_p[two_keys[missing] & low])
    three = p3.drop("n").toArrow().sort_by("key")
    none = np.array([-1], np.int64)
    logs = lambda x: np.concatenate([[0.0], np.log10(x)]).astype(np.float32)
    return Model(
        numbers,
        np.concatenate([none, three["key"].to_numpy()]),
        logs(three["p"].to_numpy()),
        np.concatenate([none, two_keys]),
        logs(two_p),
        logs(np.where(np.isnan(two_left), 1.0, two_left)),
        uni_p.astype(np.float32),
        uni_left.astype(np.float32),
        model.spelling,
    )


def spelling(counted: DataFrame) -> np.ndarray:
    """log10 of the smoothed bigram probabilities of the bytes of different words (column word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            b = np.frombuffer(b" " + b" ".join(batch.column(0).to_pylist()) + b" ", np.uint8).astype(np.int64)
            counts += np.bincount(b[:-1] << 8 | b[1:], minlength=1 << 16)
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(counts[pair], pa.int64())], ["pair", "n"])

    got = counted.select("word").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(1 << 16)
    counts[got["pair"].to_numpy()] += got["n"].to_numpy()
    counts = counts.reshape(256, 256)
    return np.log10(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_tokens (words and the end), log_ppl (mean of -log10 p over them; null for a text without words)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([named.schema["doc_id"], named.schema["lang"], T.StructField("n_tokens", T.LongType()), T.StructField("log_ppl", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value

        def out(ids: list[pa.Array], held: list[np.ndarray], spelled: list[float]) -> pa.RecordBatch:
            sizes = np.array(list(map(len, held)))
            ends = np.cumsum(sizes)
            logs = model.logs(np.concatenate(held), ends - sizes)
            n = sizes - 2
            total = np.add.reduceat(logs, np.cumsum(n) - n) + np.array(spelled)
            ppl = pa.array(-total / n, pa.float64(), mask=n == 1)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], kinds[0]), pa.array([x[1] for x in ids], kinds[1]), pa.array(n, pa.int64()), ppl], schema.names)

        ids, held, spelled, so_far, kinds = [], [], [], 0, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(k).type for k in (0, 1)]
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(text)
                n = model.numbered(words)
                ids.append((doc, lang))
                held.append(n)
                spelled.append(model.spelled([words[k] for k in np.flatnonzero(n[2:-1] == UNKNOWN)]))
                so_far += len(n)
                if so_far >= TURN:
                    yield out(ids, held, spelled)
                    ids, held, spelled, so_far = [], [], [], 0
        if ids:
            yield out(ids, held, spelled)

    return named.mapInArrow(run, schema)


def thresholds(found: DataFrame) -> DataFrame:
    """(_lang, _mid, _spread): of every language, over all the documents of found with words, however few.

    Quantiles are those of nearest rank over counts by step of the log-perplexity, so they are exact to a step and don't depend on how
    rows are split. Of a language there are a few ten thousand steps at most.
    """
    steps = found.filter("log_ppl is not null").groupBy(F.col("lang").alias("_lang"), F.floor(F.col("log_ppl") * STEP).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_lang")
    ranked = steps.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_step")), "_all": F.sum("_n").over(whole)})
    at = lambda q: F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("_step"))) / STEP
    quantiles = ranked.groupBy("_lang").agg(F.first("_all").alias("_all"), at(0.25).alias("_low"), at(0.5).alias("_mid"))
    spread = ((F.col("_mid") - F.col("_low")) * F.col("_all") + USUAL * PRIOR) / (F.col("_all") + PRIOR)
    return quantiles.select("_lang", "_mid", spread.alias("_spread"))


def classify(docs: DataFrame, model: Model, fitted_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """doc_id, lang, n_tokens, log_ppl, perplexity, threshold (of log_ppl) and kept for each row of docs.

    fitted_on (doc_id), of bounded size, names documents that thresholds aren't taken over. A null or empty text, or one of white
    space, has no perplexity and isn't kept. A null language is a language of its own; each is judged by its own quantiles,
    whatever its size; one with documents of fitted_on only has no threshold and keeps them. A text at its threshold is kept. Rows
    are scored one by one: repeated rows have one verdict, null ids stay null. Without rows the result is empty. Other columns are
    ignored.
    """
    found = cut(perplexities(docs, model, id_col, text_col, lang_col))
    unseen = found if fitted_on is None else found.join(F.broadcast(fitted_on.select("doc_id").distinct()), "doc_id", "left_anti")
    return judged(found, unseen, fence)


def judged(found: DataFrame, unseen: DataFrame, fence: float) -> DataFrame:
    """The verdicts on documents of known perplexity; thresholds are taken over unseen."""
    limits = cut(thresholds(unseen))
    if limits.count() <= BROADCAST:
        limits = F.broadcast(limits)
    met = found.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.col("_mid") + fence * F.sqrt(F.col("_spread") * F.col("_spread") + F.lit((0.6745 * TOKEN) ** 2) / F.col("n_tokens"))
    some = F.col("log_ppl").isNotNull()
    return met.select(
        "doc_id", "lang", "n_tokens", "log_ppl", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"), F.when(some, limit).alias("threshold"), (some & F.coalesce(F.col("log_ppl") <= limit, F.lit(True))).alias("kept")
    )
