"""The operators with a trained model: licence scan, HTML extraction, LM scoring, quality classifier."""

import html
import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from captionforge.llm import gru, html_blocks, html_extract, kneser_ney, kneser_ney_shards, licenses, lm_scoring, page_maker

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA)


# licences


def test_licences_found_and_prose_left(spark):
    prose = "\n".join(["The river ran past the old mill and nobody was there to see it.", "She may use the general public road, version or not, as is her right."])
    texts = [(1, prose), (2, prose + "\nReleased under the MIT License."), (3, "Licensed under CC BY-NC 4.0.\nx\nLicensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "All rights reserved."), (6, "All rights reserved.")]
    df = docs_of(spark, texts)
    got = Counter((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df).collect() if r["confirmed"])
    assert got == Counter({(2, 2, "mit"): 1, (3, 0, "cc"): 1, (3, 2, "apache"): 1, (6, 0, "proprietary"): 2})


def test_licence_model_on_held_out_paragraphs(spark):
    model = licenses.fitted()
    assert model["accuracy"] > 0.9
    texts, labels = licenses.made(seed=99)
    df = docs_of(spark, list(enumerate(texts)))
    best = {r["doc_id"]: r["family"] for r in licenses.scan(df).collect()}
    right = sum(best.get(i, licenses.UNKNOWN) == y for i, y in enumerate(labels))
    assert right > 0.9 * len(labels)


def brute_scan(text):
    """(first line, last line, family, template, confirmed) by dictionaries and loops."""
    model = licenses.fitted()
    classes, n_cls = model["classes"], len(model["classes"])
    runs, lines = [[]], (text or "").split("\n")
    for i, x in enumerate(lines):
        if x.encode().split():
            runs[-1].append(i)
        else:
            runs.append([])

    def judged(first, last):
        g = licenses.grams("\n".join(lines[first : last + 1])) & set(model["weights"])
        if not g:
            return None
        z = (model["bias"] + sum(model["weights"][x] for x in g)) / model["temperature"]
        if z[:-1].max() <= z[-1]:
            return None
        f, p = int(z[:-1].argmax()), np.exp(z - z.max())
        p = float(p[:-1].max() / p.sum())
        share = [len(set(licenses.shingles(t)) & g) / len(licenses.shingles(t)) for t in licenses.TEMPLATES[classes[f]]]
        k = int(np.argmax(share))
        sure = p >= model["threshold"] and share[k] >= licenses.CONFIRM
        return first, last, classes[f] if p >= model["threshold"] else licenses.UNKNOWN, f"{classes[f]}/{k}", sure

    assert n_cls == len(licenses.TEMPLATES) + 1
    for run in runs:
        own = [i for i in run if licenses.grams(lines[i]) & set(model["weights"])]
        found = [j for j in (judged(i, i) for i in own) if j]
        hit = [i for i in run if licenses.grams(lines[i])]
        whole = judged(run[0], run[-1]) if len(hit) > 1 else None
        if whole and whole[4] and not any(j[4] and j[2] == whole[2] for j in found):
            yield whole[2:]
            found = [j for j in found if j[4]]
        yield from found


def wrapped(text, width=72, mark="// "):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(" ".join(text.split()), width))


def test_licences_by_brute_force(spark):
    t = licenses.TEMPLATES
    prose = "The river ran past the old mill, and nobody was there to see it.\nOne more line of the software and its terms."
    texts = [prose, f"{prose}\nReleased under the MIT License.\n{prose}", *[f"{prose}\n\n{wrapped(x)}\n\n{prose}" for f in t for x in t[f]], *[wrapped(x, 30, " * ") + "\n" + prose for f in t for x in t[f]], None, "", "\n\n", "All rights reserved.\n\n\nAll rights reserved."]
    got = {}
    for r in licenses.scan(docs_of(spark, list(enumerate(texts)))).collect():
        multi = r["last_line"] > r["paragraph"]
        row = (r["family"], r["template"], r["confirmed"])
        got.setdefault(r["doc_id"], Counter())[row if multi else (r["paragraph"], r["last_line"], *row)] += 1
    for i, text in enumerate(texts):
        assert got.get(i, Counter()) == Counter(brute_scan(text)), (i, text)


def test_wrapped_notices_are_found_whole(spark):
    lt = licenses.TEMPLATES
    code = "import os\n\ndef main():\n    return os.getcwd()"
    cases = [("mit", lt["mit"][0]), ("isc", lt["isc"][0]), ("bsd", lt["bsd"][0]), ("apache", lt["apache"][0]), ("gpl", lt["gpl"][0]), ("agpl", lt["agpl"][0]), ("lgpl", lt["lgpl"][0]), ("mpl", lt["mpl"][0]), ("epl", lt["epl"][0]), ("unlicense", lt["unlicense"][0])]
    texts = [(k, f"{wrapped(x, 66, mark)}\n\n{code}") for k, (_, x) in enumerate(cases) for mark in ("# ",)]
    texts += [(100 + k, f"{code}\n\n{wrapped(x, 40, ' * ')}") for k, (_, x) in enumerate(cases)]
    got = {}
    for r in licenses.scan(docs_of(spark, texts)).filter("confirmed").collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    for k, (family, _) in enumerate(cases):
        assert got.get(k) == {family} and got.get(100 + k) == {family}, (family, got.get(k), got.get(100 + k))


def test_ngrams_are_put_together_only_where_one_may_begin(spark):
    """Of 20,000 words, two of which begin an n-gram of the table, no row but the words' own comes from the scan's generators before the join."""
    text = " ".join(["permission is", *(f"xq{k}" for k in range(20_000))])
    plan = licenses.scan(docs_of(spark, [(1, text)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "w0" in plan
    (first,) = [x for x in plan.split("\n") if "inline(arrays_zip" in x]
    assert plan.index("Join Inner, (w0") < plan.index(first)


def test_licence_edges(spark):
    assert licenses.scan(docs_of(spark, [])).collect() == []
    long = docs_of(spark, [(1, "word " * 30_000 + "Released under the MIT License."), (None, "Released under the MIT License.")]).selectExpr("*", "'x' as paragraph", "'x' as gram", "'x' as family", "1 as t", "2 as u", "3 as lines", "4 as k")
    found = licenses.scan(long)
    assert found.columns == ["doc_id", "paragraph", "last_line", "family", "probability", "template", "overlap", "confirmed"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[None]["family"] == "mit" and got[None]["confirmed"] and got[1]["confirmed"]


# pages


def brute_article(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = [" ".join(html.unescape(re.sub(r"<(?:/?b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1])] if m else []
    return "\n\n".join(x for x in parts if x)


def test_pages_of_the_data(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == brute_article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_held_out_pages():
    w, wrong, total = html_extract.trained(), 0, 0
    for k in range(120):
        found, want = html_extract.labelled(page_maker.page(5_000_000 + k))
        got = html_extract.label([html_extract.inner(html_blocks.features(found), w)], w)[0]
        wrong, total = wrong + int((got != np.array(want)).sum()), total + len(want)
    assert wrong < 0.01 * total


def test_blocks_of_untidy_markup():
    texts = lambda p: [t for t, _ in html_blocks.blocks(p)]
    assert texts("<p>a &amp; b&nbsp;&#233;<br>c<p>d<b>e</b>f") == ["a & b é c", "def"]
    assert texts("<script>if (a < b) '</p>'</script><style>p{}</style>x<!-- y --> z") == ["x z"]
    assert texts('<a title="a > b">k</a>< 3 <ul><li>one<li>two</ul>') == ["k< 3", "one", "two"]
    assert texts("<div hidden") == [] and texts("") == [] and texts("</p></div>") == []
    assert texts("<textarea><p>no</textarea><p>yes") == ["yes"]
    assert len(texts("<div>" * 5000 + "deep")) == 1


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>Home</a></nav>"), (None, "u", "<article><h1>Title</h1>" + "<p>A long enough sentence of words, said once more. " * 3000 + "</article>")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = html_extract.extract(df).collect()
    assert len(got) == 8 and [r["text"] for r in got if r["page_id"] in (1, 2)] == [""] * 4
    assert all(r["text"].count("\n\n") == 3000 for r in got if r["page_id"] is None)
    assert html_extract.extract(df.limit(0)).collect() == []


def test_long_page_is_described_as_in_one_piece():
    found = html_blocks.blocks("<article>" + "".join(f"<p>Block {k} of a long page.</p>" for k in range(10_000)) + "</article>")
    assert len(found) == 10_000
    w = html_extract.fresh(1)
    got = html_extract.vectored(found, w)
    assert np.allclose(got, html_extract.inner(html_blocks.features(found), w), atol=1e-6)


def test_lstm_gradient():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_extract.fresh(1).items()}
    e, there = r.standard_normal((5, 3, html_extract.INNER)), np.ones((5, 3))
    there[3:, 1] = 0
    up = r.standard_normal((5, 3, html_extract.HIDDEN)) * there[:, :, None]
    for d in "fb":
        loss = lambda: float((html_extract.lstm(e, there, w, d)[0] * up).sum())  # noqa: B023, E731
        grad = {}
        _, kept = html_extract.lstm(e, there, w, d)
        html_extract.lstm_back(up, e, kept, w, d, grad)
        for name in (f"W{d}", f"U{d}", f"b{d}"):
            at = (1, 2) if w[name].ndim == 2 else (2,)
            w[name][at] += 1e-2
            high = loss()
            w[name][at] -= 2e-2
            low = loss()
            w[name][at] += 1e-2
            assert abs((high - low) / 2e-2 - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at]))


# language model


def is_held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def lm_docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(900_001, None), (900_002, ""), (None, "The the THE"), (900_003, "word " * 30_000), rows[3], rows[3]]


def test_lm_base_and_gain(spark, lm_docs):
    df = docs_of(spark, lm_docs).selectExpr("*", "'x' as score", "1 as known", "'y' as rare")
    got = lm_scoring.lm_scores(df, most_frequent=500, own=200).collect()
    counts = Counter()
    for i, t in lm_docs:
        if not is_held(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in lm_docs:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, is_held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_scores_do_not_depend_on_partitions(spark, lm_docs):
    df = docs_of(spark, lm_docs)
    at = lambda n: sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_scoring.lm_scores(df.repartition(n), most_frequent=500, own=200, shard=8000).collect())
    first = at(1)
    for n in (8, 64):
        for a, b in zip(first, at(n), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-5 * abs(a[2]) + 1e-6


def test_means_in_a_tree(spark):
    import pyarrow as pa

    t = pa.table({"at": [5, 3], "piece": [0, 0], "n": [3, 1], "data": pa.array([np.float32([1, 2]).tobytes(), np.float32([5, 6]).tobytes()], pa.binary())})
    (r,) = lm_scoring.mean(t, 64).to_pylist()
    assert (r["at"], r["piece"], r["n"]) == (0, 0, 4) and np.frombuffer(r["data"], np.float32).tolist() == [2, 3]


def test_lm_edges(spark):
    assert lm_scoring.lm_scores(docs_of(spark, [])).collect() == []
    only_held = next(i for i in range(99) if is_held(i))
    (r,) = lm_scoring.lm_scores(docs_of(spark, [(only_held, "a b")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0


def small_vocabulary():
    top = [(w.encode(), n) for w, n in (("the", 40), ("of", 20), ("a", 9), ("cat", 4), ("dog", 3))]
    words = top + [(b"rare", 1), (b"words", 1)]
    mass = Counter()
    for w, n in words:
        mass[lm_scoring.ending(w) % lm_scoring.RESTS] += n + 0.5
    return lm_scoring.Vocabulary(top, 10, mass, 3), words


def test_lm_sums_to_one_and_carries_its_state():
    voc, words = small_vocabulary()
    learner = gru.Learner(gru.fresh(voc.layout), voc.layout)
    texts = [voc.ids("the cat of the dog a the")[0] for _ in range(30)]
    before = gru.score(learner.p, voc.layout, texts[:1])[0]
    for _ in range(20):
        learner.learn(texts)
    assert gru.score(learner.p, voc.layout, texts[:1])[0] > before
    # given any start, the next token is one of the known words, the end, or an unknown one of each rest class
    start = voc.ids("the cat")[0][:-1]
    base = gru.score(learner.p, voc.layout, [start])[0]
    options = [voc.ids(w.decode())[0][:1] for w, _ in words] + [np.zeros(1, np.int32)]
    extra = [math.log(n + 0.5) if voc.ids(w.decode())[0][0] > voc.n_top else 0.0 for w, n in words] + [0.0]
    total = sum(math.exp(gru.score(learner.p, voc.layout, [np.concatenate([start, o])])[0] - base + x) for o, x in zip(options, extra, strict=True))
    unknown = [np.array([voc.n_top + 1 + next(b for b in range(lm_scoring.ENDINGS) if b % lm_scoring.RESTS == k)], np.int32) for k in range(lm_scoring.RESTS)]
    total += sum(0.5 * math.exp(gru.score(learner.p, voc.layout, [np.concatenate([start, o])])[0] - base) for o in unknown)
    assert abs(total - 1) < 1e-3
    # learning carries it as well: a text a window long is learnt otherwise than its halves
    whole = [np.concatenate([texts[0][:-1]] * 20)]
    halves = [h for t in whole for h in np.array_split(t, 2)]
    a, b = (gru.Learner(learner.p, voc.layout) for _ in range(2))
    a.learn(whole)
    b.learn(halves)
    assert not np.allclose(a.p["N"], b.p["N"])
    # one step at a time, without lanes or windows
    long = np.concatenate([texts[0][:-1]] * 40 + [np.zeros(1, np.int32)])
    state, by_hand = np.zeros((1, gru.HIDDEN), np.float32), 0.0
    for t in long:
        states, after = gru.forward(learner.p, learner.p["E"][voc.layout.inputs[[[t]]]], np.ones((1, 1, 1), np.float32), state)
        by_hand += gru.predict(learner.p, voc.layout, states[0], np.array([t]))[0][0]
        state = after
    got = gru.score(learner.p, voc.layout, [texts[0], long, texts[1]])
    assert abs(got[1] - by_hand) < 1e-3 * abs(by_hand)


def test_gru_gradient():
    voc, _ = small_vocabulary()
    p = {k: v + np.random.default_rng(2).standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in gru.fresh(voc.layout).items()}
    ids = voc.ids("the cat of the dog a rare")[0][:, None]
    keep = np.ones((len(ids), 1, 1), np.float32)

    def loss():
        out, _ = gru.forward(p, p["E"][voc.layout.inputs[ids]], keep, np.zeros((1, gru.HIDDEN), np.float32))
        return -gru.predict(p, voc.layout, out[:, 0], ids[:, 0])[0].astype(float).mean()

    kept, grad = [], {}
    out, _ = gru.forward(p, p["E"][voc.layout.inputs[ids]], keep, np.zeros((1, gru.HIDDEN), np.float32), kept)
    _, up = gru.predict(p, voc.layout, out[:, 0], ids[:, 0], grad)
    gru.backward(p, up[:, None], out, keep, kept, grad)
    for name in ("G", "N", "g", "C", "c", "W", "w"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        p[name][at] += 1e-2
        high = loss()
        p[name][at] -= 2e-2
        low = loss()
        p[name][at] += 1e-2
        assert abs((high - low) / 2e-2 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-3, name


def test_gru_steps_as_written_out():
    """Gradients at inputs, with texts that start within a window, and logits too large for exp; in double precision, token by token."""
    voc, _ = small_vocabulary()
    r, h = np.random.default_rng(4), gru.HIDDEN
    p = {k: (v + r.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in gru.fresh(voc.layout).items()}
    e, keep, up = r.standard_normal((7, 3, 3 * h)), np.ones((7, 3, 1), np.float32), r.standard_normal((7, 3, h))
    keep[0, 1] = keep[4, 0] = keep[4, 2] = 0
    begin = r.uniform(-0.9, 0.9, (3, h))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(e):
        state, out = begin, []
        for t in range(7):
            state = state * keep[t]
            out.append(state)
            z, reset = (sigmoid(e[t, :, k : k + h] + p["g"][k : k + h] + state @ p["G"][:, k : k + h]) for k in (0, h))
            state = state + z * (np.tanh(e[t, :, 2 * h :] + (reset * state) @ p["N"]) - state)
        return np.stack(out), state

    kept, grad, want = [], {}, plain(e)
    f32 = lambda x: x.astype(np.float32)
    for got in (gru.forward(p, f32(e), keep, f32(begin), kept), gru.forward(p, f32(e), keep, f32(begin))):
        assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(got, want, strict=True))
    de = gru.backward(p, f32(up), got[0], keep, kept, grad)
    for at in [(0, 0, 3), (2, 1, h + 2), (3, 0, 2 * h), (3, 1, 5), (4, 2, 2 * h + 1), (5, 2, h), (6, 0, 0)]:
        far = np.zeros_like(e)
        far[at] = 1e-5
        assert abs((((plain(e + far)[0] - plain(e - far)[0]) * up).sum() / 2e-5) - de[at]) < 1e-3
    # the same logits with and without lowering
    ids, state = np.array([0, 1, 2, 3, voc.n_top + 1]), f32(r.uniform(-0.9, 0.9, (5, h)))
    for scale in (1, 60):
        big = {k: v * np.float32(scale if k in "CcWw" else 1) for k, v in p.items()}
        c = voc.layout.classes[ids]
        z = state.astype(float) @ big["C"] + big["c"]
        want = z[range(5), c] - np.logaddexp.reduce(z, axis=1) + voc.layout.rest[ids]
        for k, one in enumerate(c):
            if one < len(voc.layout.starts) - 1:
                lo, hi = voc.layout.starts[one : one + 2]
                z = big["W"][lo:hi].astype(float) @ state[k] + big["w"][lo:hi]
                want[k] += z[voc.layout.within[ids[k]]] - np.logaddexp.reduce(z)
        assert np.allclose(gru.predict(big, voc.layout, state, ids)[0], want, rtol=1e-4, atol=1e-4)


def test_sums_by_row():
    rows = np.minimum(np.random.default_rng(0).zipf(1.5, 3000), 400).astype(np.uint16)
    values = np.random.default_rng(1).standard_normal((3000, 6)).astype(np.float32)
    own, got = gru.sums_by_row(rows, values)
    want = np.zeros((401, 6))
    np.add.at(want, rows, values)
    assert own.tolist() == sorted(set(rows.tolist())) and np.allclose(got, want[own], atol=1e-3)


def test_learning_keeps_memory_between_steps():
    """What a step frees isn't given back and taken page by page again: a quarter of op8's learning went there."""
    code = """
import resource
import numpy as np
from captionforge.llm import gru, lm_scoring
layout = lm_scoring.Vocabulary([(b"a", 3), (b"b", 2)], 1, {}, 2).layout
gru.Learner(gru.fresh(layout), layout).learn([np.array([1, 2, 0], np.int32)])
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
before = faults()
for _ in range(40):
    held = [np.ones(1 << 18, np.float32) for _ in range(10)]
    del held
print(faults() - before)
"""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": home}, capture_output=True, text=True, check=True, timeout=120)
    # ten arrays have 2560 pages; forty times that otherwise
    assert int(done.stdout) < 4 * 2560


def test_rare_words_are_listed_flat():
    import pyarrow as pa

    rare = [Counter({f"wörd{k}-{j}".encode(): j + 1 for j in range(k % 40)}) for k in range(3000)]
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def spent(f):
        began = time.process_time()
        return f(), time.process_time() - began

    flat = [spent(lambda: lm_scoring.listed(rare)) for _ in range(5)]
    each = [spent(lambda: pa.array([[{"word": w.decode(), "n": n} for w, n in c.items()] for c in rare], kind)) for _ in range(5)]
    assert flat[0][0].equals(each[0][0]) and flat[0][0].type == kind
    assert 2 * min(t for _, t in flat) < min(t for _, t in each)
    assert lm_scoring.listed([Counter()]).to_pylist() == [[]]


# Kneser-Ney


@pytest.fixture(scope="module")
def trusted(spark):
    texts = ["the cat sat on the mat", "the cat ate the dog", "a dog sat on the cat", "the dog ate", "on the mat the cat sat", "a cat sat on a mat"] * 3 + ["the mat", None, ""]
    return spark.createDataFrame([(t,) for t in texts], "text string")


def brute_kn(texts, known):
    """Modified Kneser-Ney by dictionaries: p(c | a, b)."""
    toks = [(t or "").lower().split() for t in texts]
    vocab = {w for w, n in Counter(w for t in toks for w in t).items() if n >= known}
    seqs = [["<s>", "<s>", *(w if w in vocab else "?" for w in t), "</s>"] for t in toks]
    tri = Counter(tuple(s[k : k + 3]) for s in seqs for k in range(len(s) - 2))
    bi = Counter(g[1:] for g in tri)
    uni = Counter((g[1],) for g in bi)

    def discounts(c):
        return kneser_ney.discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])

    def level(c, lower):
        d = discounts(c)
        total, left = Counter(), Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]

        def p(g):
            ctx = g[:-1]
            if ctx not in total:
                return lower(g[1:])
            n = c.get(g, 0)
            return (n - (d[min(n, 3) - 1] if n else 0)) / total[ctx] + left[ctx] / total[ctx] * lower(g[1:])

        return p

    flat = 1 / (len(vocab) + 2)
    return level(tri, level(bi, level(uni, lambda g: flat))), vocab


def kneser_ney_hot(monkeypatch):
    """Keys of more than two n-grams are joined apart, so both ways are taken."""
    monkeypatch.setattr(kneser_ney, "HOT", 2)


def test_kneser_ney_brute(trusted, monkeypatch):
    kneser_ney_hot(monkeypatch)
    model = kneser_ney.fit(trusted)
    p, vocab = brute_kn([r["text"] for r in trusted.collect()], kneser_ney.KNOWN)
    for text in ["the cat sat", "dog the a mat", "", "zebra the unknown cat", "on on on"]:
        words = text.split()
        n = model.numbered([w.encode() for w in words])
        s = ["<s>", "<s>", *(w if w in vocab else "?" for w in words), "</s>"]
        want = [math.log10(p(tuple(s[k : k + 3]))) for k in range(len(s) - 2)]
        assert np.allclose(model.logs(n, np.array([0])), want, atol=1e-4), text
    every = np.array([k for k in range(len(model.numbers) + 3) if k != kneser_ney.START])
    for a, b in [(1, 1), (1, 3), (3, 4), (0, 0)]:
        n = np.stack([np.full(len(every), a), np.full(len(every), b), every], 1).ravel()
        assert abs((10.0 ** model.logs(n, np.arange(0, len(n), 3))).sum() - 1) < 1e-4


def test_quality_classifier(spark, trusted):
    model = kneser_ney.fit(trusted)
    good, bad = "the cat sat on the mat and the dog ate", "zq%%% xk### vv!! qqq$$$ zzz*** kkk### jj%%% xx!!"
    rows = [(i, good, lang, None, None) for i in range(120) for lang in ("en", None)] + [(1000 + i, bad, "en", None, None) for i in range(20)]
    rows += [(2000, None, "en", None, None), (2001, " ", "en", None, None), (None, good, "xx", None, None), (2002, "the cat " * 20_000, "en", None, None), (2003, bad, "xx", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "1 as threshold", "1 as n")
    got = kneser_ney.classify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (2000, 2001):
            assert (r["perplexity"], r["kept"], r["n_tokens"]) == (None, False, 1)
        else:
            assert r["kept"] == (r["doc_id"] is None or r["doc_id"] < 1000 or r["doc_id"] == 2002), r
    assert kneser_ney.classify(df.limit(0), model).collect() == []


def test_rare_language_beside_a_large_one(spark, trusted):
    """Clean documents of few rows, in words that the model doesn't know, are judged by their own kind."""
    model = kneser_ney.fit(trusted)
    rows = [(i, "the cat sat on the mat and the dog ate", "en", None, None) for i in range(100)]
    rows += [(1000 + i, f"žluťoučký kůň příšerně úpěl ďábelské ódy večer {'ještě ' * (i % 3)}", lang, None, None) for i in range(6) for lang in ("cs", None)]
    got = kneser_ney.classify(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and all(r["kept"] for r in got)


def test_clean_labelled_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    trusted = kneser_ney.trusted_sample(docs, labels)
    model = kneser_ney.fit(trusted)
    got = kneser_ney.classify(docs, model, trusted).join(labels, "doc_id").filter("n_tokens > 40")
    rows = got.select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.7


def test_verdicts_by_brute_force(spark, trusted):
    """classify by loops: perplexities from the model alone, quantiles from sorted lists, whatever the partitions."""
    model, rnd = kneser_ney.fit(trusted), np.random.default_rng(4)
    vocab = ["the", "cat", "sat", "on", "mat", "dog", "zebra", "xq%%", "ate"]
    rows = [(i, " ".join(rnd.choice(vocab, rnd.integers(0, 30))), ["en", "de", None, "fr"][i % 7 % 4], None, None) for i in range(150)] + [(3, "the cat", "en", None, None), (None, "a mat", "xx", None, None)]
    seen = [0, 7, 14]
    per = []
    for i, text, lang, *_ in rows:
        w = text.encode().split()
        n = model.numbered(w)
        total = model.logs(n, np.array([0])).astype(float).sum() + model.spelled([x for x in w if x not in model.numbers])
        per.append((i, lang, len(w) + 1, -total / (len(w) + 1) if w else None))
    want: Counter = Counter()
    for i, lang, n, p in per:
        own = sorted(math.floor(q * kneser_ney.STEP) for j, other, _, q in per if other == lang and q is not None and j not in seen)
        at = lambda x: own[math.ceil(len(own) * x) - 1] / kneser_ney.STEP  # noqa: B023, E731
        spread = ((at(0.5) - at(0.25)) * len(own) + kneser_ney.USUAL * kneser_ney.PRIOR) / (len(own) + kneser_ney.PRIOR)
        limit = at(0.5) + kneser_ney.FENCE * math.sqrt(spread**2 + (0.6745 * kneser_ney.TOKEN) ** 2 / n)
        want[i, lang, n, p is not None and p <= limit, None if p is None else round(limit, 2)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(i,) for i in seen], "doc_id long")
    for parts in (1, 7):
        got = kneser_ney.classify(df.repartition(parts), model, known).collect()
        assert Counter((r["doc_id"], r["lang"], r["n_tokens"], r["kept"], None if r["threshold"] is None else round(r["threshold"], 2)) for r in got) == want
    assert 0 < sum(not k[3] for k in want if k[2] > 1)


def test_no_trusted_text(spark):
    model = kneser_ney.fit(spark.createDataFrame([], "text string"))
    (r,) = kneser_ney.classify(docs_of(spark, [(1, "a b c")]), model).collect()
    assert r["kept"] and r["n_tokens"] == 4


def every_label(spark, rows, path):
    """Documents and labels as files; the texts of the trusted ones, repeated rows as often as they are there."""
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    good = {i for i, *_ in rows if i is not None and i % 3}
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in range(0, 60, 6)] + [(3, 1, 1)]
    return spark.read.parquet(f"{path}/documents.parquet"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [(t,) for i, t, *_ in rows if i in good]


@pytest.mark.parametrize(("shards", "frequent"), [(None, 1 << 17), (7, 5)])
def test_counts_of_all_trusted_texts(spark, tmp_path, monkeypatch, shards, frequent):
    """The sharded model against fit of all trusted texts: one shard, and several over which the frequent words are spread."""
    rnd = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(60)] + ["Ünï", "the", "the", "the", "the"]
    rows = [(i, " ".join(rnd.choice(vocab, rnd.integers(0, 40))) + (f" only{i}" if i % 4 == 0 else ""), ["en", "de", None][i % 5 % 3], None, None) for i in range(300)]
    rows += [(1, "w1 w2 the w3", "en", None, None), (None, "the w1", "en", None, None), (301, None, "de", None, None), (302, "", "de", None, None), (304, "the w4 " * 3000, "en", None, None)]
    docs, labels, texts = every_label(spark, rows, tmp_path)
    if shards:
        real, spans = kneser_ney_shards.placed, []
        monkeypatch.setattr(kneser_ney_shards, "placed", lambda *x: (spans.append(real(*x)), spans[0])[1])
    model = kneser_ney.fit(spark.createDataFrame(texts, "text string"))
    want = sorted((str(r["doc_id"]), str(r["lang"]), r["n_tokens"], -1 if r["log_ppl"] is None else r["log_ppl"]) for r in kneser_ney.perplexities(docs, model).collect())
    got = kneser_ney_shards.perplexities(docs, labels, shards=shards, frequent=frequent, chunk=900, part=40 if shards else 1 << 19).collect()
    assert all(r["trusted"] == bool(r["doc_id"] and r["doc_id"] % 3) for r in got)
    got = sorted((str(r["doc_id"]), str(r["lang"]), r["n_tokens"], -1 if r["log_ppl"] is None else r["log_ppl"]) for r in got)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-4)
    if shards:
        assert len(spans[0].hot) > 1 and max(spans[0].spans) > 1


def test_no_text_beyond_a_sample_is_left_out(spark, tmp_path):
    """More labelled texts than the sample has: words of each one are known to the query."""
    rows = [(i, f"rare{i} rare{i} rare{i} rare{i}", "en", None, None) for i in range(1, kneser_ney.TRUSTED * 2)]
    docs, labels, texts = every_label(spark, rows, tmp_path)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert len(texts) > kneser_ney.TRUSTED * 1.2
    got = kneser_ney_shards.op9_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    known = [r["log_ppl"] for r in got if r["doc_id"] % 3]
    assert max(known) < min(r["log_ppl"] for r in got if r["doc_id"] % 3 == 0)


def test_no_labels(spark, tmp_path):
    docs, labels, _ = every_label(spark, [(1, "a b c", "en", None, None), (2, None, "en", None, None)], tmp_path)
    got = {r["doc_id"]: r for r in kneser_ney_shards.classify_by_labels(docs, labels.limit(0)).collect()}
    assert (got[1]["kept"], got[1]["n_tokens"], got[2]["kept"], got[2]["perplexity"]) == (True, 4, False, None)
    assert kneser_ney_shards.classify_by_labels(docs.limit(0), labels).collect() == []
