"""corpus_pipeline.run and its stages against brute force, over rows that ids don't tell apart and columns named like the stages' own."""

import hashlib
import os
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash

import corpus_pipeline
from captionforge.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from captionforge.llm.common import cut, passing

from .test_core import brute_components, brute_fingerprint, brute_quality, brute_targets, brute_words

NAMES = ["_counts", "_lines", "_q", "q", "row", "key", "_kept_id", "_mix_id", "_taken", "_size", "_copy", "_short", "_metadata", "_fp", "_text", "_best", "copy", "part", "size", "taken"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SEPARATORS, SYMBOLS = "|»›•·", "#*$%&|<>"


def low(text):
    return (text or "").encode().lower().decode()


def line_fails(x):
    w, n = brute_words(x), len(brute_words(x))
    sep, sym, bang = (sum(x.count(c) for c in chars) for chars in (SEPARATORS, SYMBOLS, "!"))
    return (
        (sep >= 3 and sep * 5 >= n)
        or (sym >= 3 and sym * 10 > len(x))
        or (bang >= 3 and bang * 5 >= n)
        or (n >= 10 and len(set(w)) * 10 < n * 3)
        or (n >= 8 and not re.search("[.!?…。！？:;]", x))
        or (n <= 12 and bool(re.search(quality_rules.BOILERPLATE, low(x))))
    )


def brute_rules(rows):
    for r in rows:
        n, _, _, _, repeats = brute_quality(r["text"])
        lines = (r["text"] or "").split("\n")
        lost = sum(len(brute_words(x)) for x in lines if line_fails(x))
        if n >= 10 and 100 * repeats <= 20 * n and 100 * lost <= quality_rules.MOST_LOST * n:
            text = "\n".join(x for x in lines if not (line_fails(x) and brute_words(x))) if lost else r["text"]
            yield r | {"text": text, "n_chars": len(text) if lost else r["n_chars"]}


def first(groups, key):
    return [min(g, key=key) for g in groups.values()]


def ident(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r["text"])].append(r)
    return first(groups, lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))


def brute_near(rows):
    prints = {i: [brute_fingerprint(r["text"], simhash.NEAR_SHINGLE, k) for k in range(simhash.PRINTS)] for i, r in enumerate(rows)}
    groups = defaultdict(list)
    for k, c in brute_components(prints).items():
        groups[c].append(rows[k])
    return first(groups, ident)


def line_order(r):
    h = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
    return xxhash.xxh64_intdigest((r["text"] or "").encode(), h)


def brute_mix(rows):
    """Each row with the words that are taken of it: whole passes over its source's line, and what the last one reaches."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: sum(len(brute_words(r["text"])) for r in rs) for s, rs in by.items()}
    want = brute_targets(sizes) if sizes else {}
    for s, rs in by.items():
        take = min(int(want[s] + Fraction(1, 2)), 3 * sizes[s]) if sizes[s] else 0
        at = 0
        for r in sorted(rs, key=line_order):
            n = len(brute_words(r["text"]))
            yield r, (take // sizes[s] * n + max(0, min(at + n, take % sizes[s]) - at)) if n else 0
            at += n


def brute_mixed(rows):
    for r, n in brute_mix(rows):
        w = brute_words(r["text"])
        while n > 0:
            part = " ".join(w[:n])
            yield r if n >= len(w) else r | {"text": part, "n_chars": len(part)}
            n -= len(w)


def corpus():
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "And", "naïve,", "日本"]
    prose = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(9, 30))) + "." for _ in range(n))
    texts = [prose(rnd.choice([1, 2, 5])) for _ in range(60)]
    menu = "Home | About | Contact | Terms"
    rows = [(i, t if i % 7 else t + "\n" + menu, "en", rnd.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    a, b = prose(3), prose(4)
    rows += [(70, a, "en", "s1")] * 3  # repeated rows
    rows += [(7_000, b, "en", "s0"), (9_000, b.upper(), "en", "s0"), (7_000, prose(2), "en", "s0")]  # one id, two texts, one of them twice
    rows += [(None, texts[4], "en", "s0"), (None, prose(2), "de", "s1")] + [(None, prose(3), None, None)] * 2  # null ids
    long = prose(60)
    rows += [(200, long, "en", "s1"), (201, long.replace("w7 ", "w8 ", 1), "en", "s1"), (None, long.replace("w9 ", "w3 ", 1), "en", "s0")]  # near copies
    rows += [(300, None, None, None), (None, None, None, None), (301, "", "en", "s9"), (302, "!!! " * 12, "en", "s1"), (303, "too short", "en", "s1")]
    return [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": len(t or "")} for i, t, lang, s in rows]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(4)
    return df.select("*", *[F.lit(7).alias(n) for n in NAMES])


def counted(rows):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


STAGES = [(quality_rules.keep_quality, lambda r: list(brute_rules(r))), (exact_dedup.keep_exact, brute_exact), (simhash.keep_near, brute_near), (mixing.mixed_rows, lambda r: list(brute_mixed(r)))]


@pytest.mark.parametrize(("stage", "brute"), STAGES)
def test_stage_by_brute_force(spark, stage, brute):
    rows = corpus()
    given = frame(spark, rows)
    got = stage(given)
    assert got.schema.simpleString() == given.schema.simpleString() and got.columns == [*rows[0], *NAMES]
    found = got.collect()
    assert counted(found) == counted(brute(rows)) and all(r[n] == 7 for r in found for n in NAMES)
    empty = stage(given.limit(0))
    assert empty.columns == got.columns and empty.collect() == []


def test_taken_of_each_row_by_brute_force(spark):
    rows = corpus()
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(frame(spark, rows)).collect())
    assert got == Counter((r["doc_id"], len(brute_words(r["text"])), n) for r, n in brute_mix(rows))


def test_run_by_brute_force(spark, tmp_path):
    """Also what is left: stages' own tables are gone, and the last stage's input is there until the session ends."""
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(bpe.default_tokenizer()), corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    own = f"{spark.conf.get('spark.checkpoint.dir')}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(own)) if os.path.isdir(own) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(own)) - before) == 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    for _, brute in STAGES:
        rows = brute(rows)
    want: Counter = Counter()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert len(want) > 40 and got == want


def test_passing_keeps_what_it_is_told(spark):
    with passing(spark) as keep:
        a, b = cut(spark.range(3)), keep(cut(spark.range(4)))
    assert b.count() == 4 and not os.path.exists(a._folder)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
