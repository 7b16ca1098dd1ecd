"""Licence scans with a trained paragraph classifier; the scan itself is DataFrame functions only.

A sparse logistic regression over word 1- to 3-grams (one class per licence family and one for paragraphs of no family) is fitted
here, in numpy, on paragraphs made from the licence templates of `licence_texts` and on made-up prose. Scores become
probabilities by a temperature fitted on held-out paragraphs, and a paragraph is of unknown family where the best family's
probability is below a threshold that the same held-out paragraphs set. What the classifier names is then compared with the
family's templates: the share of a template's word 3-grams that the paragraph has must reach `CONFIRM`.

A paragraph is a run of lines between blank ones, whatever its wraps, and every line of it is looked at by itself as well, since a
notice may be one line of a longer text. The fitted table has at most FEATURES rows whatever the input, so it is broadcast: n-grams meet
it without an exchange, and only the numbers of those found go on, together with the lines they begin and end in.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, words
from .licence_texts import PROSE, TEMPLATES

#: Rows of the fitted table at most; n-gram lengths; share of a template that confirms a prediction.
FEATURES, GRAMS, CONFIRM = 4096, (1, 2, 3), 0.6
UNKNOWN = "unknown"
MARKS = ".,;:()[]\"'*#/<>!"
#: What begins a line of a comment, a list or a table.
LEADING = r"^[\x20\x09-\x0D\-%|+=~;#*/]+"
#: Training paragraphs made per family and of no family, share held out, passes.
MADE, NONE, HELD, STEPS, SEED = 60, 400, 0.25, 300, 7


def tokens(text: str) -> list[str]:
    """Words in lower case (A-Z), with punctuation taken for white space."""
    bare = "\n".join(re.sub(LEADING, "", x) for x in text.split("\n"))
    return [w.decode() for w in bare.translate(str.maketrans(MARKS, " " * len(MARKS))).encode().lower().split()]


def grams(text: str) -> set[str]:
    w = tokens(text)
    return {" ".join(w[i : i + n]) for n in GRAMS for i in range(len(w) - n + 1)}


def shingles(text: str) -> list[str]:
    """The word 3-grams of a template, or the whole of a shorter one."""
    w = tokens(text)
    n = min(GRAMS[-1], len(w))
    return sorted({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})


def made(seed: int = SEED) -> tuple[list[str], list[str]]:
    """Paragraphs and their families: templates with words lost or changed and prose around them, and prose alone."""
    rnd, texts, labels = random.Random(seed), [], []
    prose = [w for p in PROSE for w in p.split()]

    def filler(n: int) -> list[str]:
        at = rnd.randrange(len(prose))
        return [rnd.choice(prose) if rnd.random() < 0.5 else prose[(at + i) % len(prose)] for i in range(n)]

    for family, templates in sorted(TEMPLATES.items()):
        for _ in range(MADE):
            w = [x if rnd.random() > 0.04 else rnd.choice(prose) for x in rnd.choice(templates).split() if rnd.random() > 0.03]
            texts.append(" ".join(filler(rnd.choice([0, 0, 0, 4, 12, 80])) + w + filler(rnd.choice([0, 0, 6, 20, 120]))))
            labels.append(family)
    for _ in range(NONE):
        # no family: prose, and licence words out of their order
        w = filler(rnd.choice([5, 15, 30, 60, 150, 300]))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(rnd.choice(TEMPLATES[rnd.choice(sorted(TEMPLATES))]).split())
        texts.append(" ".join(w))
        labels.append(UNKNOWN)
    return texts, labels


@functools.lru_cache(maxsize=1)
def fitted() -> dict:
    """The weights by n-gram, the biases, the temperature, the threshold of the unknown class, and the held-out accuracy."""
    texts, labels = made()
    classes = [*sorted(TEMPLATES), UNKNOWN]
    sets = [grams(t) for t in texts]
    seen: dict[str, set[str]] = {}
    for s, y in zip(sets, labels, strict=True):
        for g in s:
            seen.setdefault(g, set()).add(y)
    # n-grams of the templates; of those the ones found in the fewest classes, and long before short
    known = {g for ts in TEMPLATES.values() for t in ts for g in grams(t)}
    names = sorted(known, key=lambda g: (len(seen.get(g, ())), -g.count(" "), g))[:FEATURES]
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(sets), len(names)))
    for i, s in enumerate(sets):
        hit = [at[g] for g in s if g in at]
        x[i, hit] = 1
    y = np.array([classes.index(c) for c in labels])
    order = np.random.default_rng(SEED).permutation(len(y))
    held, train = order[: int(len(y) * HELD)], order[int(len(y) * HELD) :]
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[y[train]]
    for step in range(STEPS):
        z = x[train] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        rate, g = 2.0 / (1 + step / 100), (p - target) / len(train)
        w -= rate * (x[train].T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 1e-5, 0)  # sparse
    z = x[held] @ w + b

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    family, best = p[:, :-1].argmax(1), p[:, :-1].max(1)
    right = lambda t: np.mean(np.where(best >= t, family, len(classes) - 1) == y[held])
    threshold = max(np.linspace(0.3, 0.95, 27), key=lambda t: (round(right(t), 6), -abs(t - 0.6)))
    return {"classes": classes, "weights": {g: w[i] for g, i in at.items()}, "bias": b, "temperature": float(temperature), "threshold": float(threshold), "accuracy": float(right(threshold))}


def array_of(values: list, kind: str) -> Column:
    """A literal array of fixed values: it is made once, when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence found: doc_id, paragraph, last_line, family, probability, template, overlap, confirmed.

    paragraph and last_line are the numbers, from 0, of the first and last line (cut at \\n) of what was found: a line, or a paragraph of
    several lines. Rows are what the classifier finds licence-like (a family is more probable than none); family is unknown where the
    best one's probability is below the calibrated threshold. A paragraph is given where it is confirmed and none of its lines is for
    that family, and then stands for its lines that aren't confirmed; else its lines are. Marks that begin a line (of comments, lists,
    tables) are no part of it. Null and empty texts have no row, and a very long line is one paragraph. Repeated rows are scanned
    each; ties between families go to the first by name, ties between templates to the first. Null ids stay null. Without rows the
    result is empty. Other columns are ignored.
    """
    spark, model = docs.sparkSession, fitted()
    classes, names = model["classes"], sorted(model["weights"])
    number = {g: k for k, g in enumerate(names)}
    features = spark.createDataFrame([(g, k) for g, k in number.items()], "gram string, k int")

    # words with the lines they are in, and the number of blank lines before
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    bare = lambda x: words(F.translate(F.regexp_replace(x, LEADING, ""), MARKS, " " * len(MARKS)))
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.rlike(r"^[\x20\x09-\x0D]*$").cast("int").alias("blank"), bare(x).alias("w")))
    named = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), numbered.alias("lines"))
    at = F.flatten(F.transform("lines", lambda x: F.array_repeat(x["i"], F.size(x["w"]))))
    named = named.select("doc_id", "_row", F.flatten(F.transform("lines", lambda x: x["w"])).alias("t"), at.alias("at"), F.filter(F.transform("lines", lambda x: F.when(x["blank"] == 1, x["i"])), lambda x: x.isNotNull()).alias("blanks"))
    # every word with the ones after it; only where an n-gram may begin are n-grams put together
    longest = max(GRAMS)
    first = spark.createDataFrame([(w,) for w in sorted({g.split(" ")[0] for g in names})], "w0 string")
    after = [F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0))).alias(f"w{k}") for k in range(longest)]
    ends = [F.slice("at", k + 1, F.greatest(F.size("at") - k, F.lit(0))).alias(f"i{k}") for k in range(longest)]
    begun = named.select("doc_id", "_row", "blanks", F.inline(F.arrays_zip(*after, *ends))).join(F.broadcast(first), "w0")
    run = lambda n: F.when(F.col(f"w{n - 1}").isNotNull(), F.struct(F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("gram"), F.col("i0").alias("a"), F.col(f"i{n - 1}").alias("b")))
    grams = begun.select("doc_id", "_row", "blanks", F.explode(F.array(*[run(n) for n in GRAMS])).alias("g")).filter("g is not null").select("doc_id", "_row", "blanks", "g.*")
    # few n-grams are left, so what a blank line parts is told of these only
    met = grams.join(F.broadcast(features), "gram").select("doc_id", "_row", "a", "b", "k", F.size(F.filter("blanks", lambda x: x < F.col("a"))).alias("run"), F.size(F.filter("blanks", lambda x: x < F.col("b"))).alias("_end"))
    per = met.filter("run = _end").groupBy("_row", "doc_id", "run").agg(F.collect_set(F.struct("a", "b", "k")).alias("hits"))

    # every line that has an n-gram for itself, and the lines from the first to the last together
    own = F.filter("hits", lambda h: h["a"] == h["b"])
    ends = F.struct(F.array_min(F.transform("hits", lambda h: h["a"])).alias("a"), F.array_max(F.transform("hits", lambda h: h["b"])).alias("b"))
    lines = F.transform(F.array_distinct(F.transform(own, lambda h: h["a"])), lambda a: F.struct(a.alias("a"), a.alias("b")))
    spans = F.concat(lines, F.filter(F.array(ends), lambda e: e["a"] < e["b"]))
    within = lambda e: F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: (h["a"] >= e["a"]) & (h["b"] <= e["b"])), lambda h: h["k"])))
    units = F.transform(spans, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), within(e).alias("ks")))
    weights = array_of([list(map(float, model["weights"][g])) for g in names], "array<array<double>>")
    bias = array_of(list(map(float, model["bias"])), "array<double>")
    z = lambda u: F.transform(F.aggregate(u["ks"], F.col("bias"), lambda acc, k: F.zip_with(acc, F.get(F.col("weights"), k), lambda x, y: x + y)), lambda x: x / model["temperature"])
    scored = per.withColumns({"weights": weights, "bias": bias}).withColumn("u", F.transform(units, lambda u: F.struct(u["a"].alias("a"), u["b"].alias("b"), u["ks"].alias("ks"), z(u).alias("z"))))
    likely = F.filter("u", lambda u: F.array_max(F.slice(u["z"], 1, len(classes) - 1)) > F.element_at(u["z"], -1))
    likely = scored.select("_row", "doc_id", "run", likely.alias("u")).filter(F.size("u") > 0)

    templates = array_of([[[number[g] for g in shingles(t)] for t in TEMPLATES[f]] for f in classes[:-1]], "array<array<array<int>>>")
    best = lambda u: F.array_position(u["z"], F.array_max(F.slice(u["z"], 1, len(classes) - 1))).cast("int")
    odds = lambda u: F.aggregate(u["z"], F.lit(0.0), lambda acc, x: acc + F.exp(x - F.element_at(u["z"], best(u))))
    share = lambda u: F.array_min(F.transform(F.element_at(F.col("templates"), best(u)), lambda t, i: F.struct((-F.size(F.array_intersect(t, u["ks"])) / F.size(t)).alias("s"), i.alias("i"))))
    held = likely.withColumn("templates", templates).withColumn("u", F.transform("u", lambda u: F.struct(u["a"].alias("a"), u["b"].alias("b"), best(u).alias("f"), (1 / odds(u)).alias("p"), share(u).alias("s"))))
    sure = lambda u: (u["p"] >= model["threshold"]) & (u["s"]["s"] <= -CONFIRM)
    whole = F.filter("u", lambda u: (u["a"] < u["b"]) & sure(u))
    other = lambda w: ~F.exists(F.col("u"), lambda u: (u["a"] == u["b"]) & sure(u) & (u["f"] == w["f"]))
    given = held.withColumn("whole", F.filter(whole, other)).withColumn("u", F.filter("u", lambda u: (u["a"] == u["b"]) & (sure(u) | (F.size("whole") == 0))))
    rows = given.select("doc_id", F.explode(F.concat("u", "whole")).alias("u"))
    family = F.element_at(F.array(*map(F.lit, classes)), F.col("u.f"))
    named = F.when(F.col("u.p") >= model["threshold"], family).otherwise(F.lit(UNKNOWN))
    return rows.select("doc_id", F.col("u.a").alias("paragraph"), F.col("u.b").alias("last_line"), named.alias("family"), F.col("u.p").alias("probability"), F.concat_ws("/", family, F.col("u.s.i").cast("string")).alias("template"), (-F.col("u.s.s")).alias("overlap"), sure(F.col("u")).alias("confirmed"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
