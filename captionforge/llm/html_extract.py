"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks (`html_blocks`). A bidirectional LSTM in numpy reads each block's tag path and hashed words, and
labels it as article or not, knowing all blocks before and after it. It is trained on the driver, on made-up pages whose parts
are known (`page_maker`), with a fixed seed; its weights have a fixed size and are broadcast. Pages are labelled where they are
read, without an exchange.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .html_blocks import FEATURES, PATHS, WORDS, blocks, features
from .page_maker import page

#: Width of a block's vector and of either direction's state; made-up pages, passes over them, pages of a step.
INNER, HIDDEN = 24, 16
MADE, PASSES, STEP, RATE, SEED = 1500, 6, 16, 0.006, 11
#: Share of the blocks whose words are withheld in a pass, and the pull of the words' weights to zero: most words say nothing of a block's use.
WITHHELD, PULL = 0.5, 1e-4
#: Rows a worker turns over at once, and padded blocks it labels at once.
ROWS, PADDED = 256, 20_000
#: Blocks of a page whose features are held at once.
SLICE = 4096

Weights = dict[str, np.ndarray]


def fresh(seed: int) -> Weights:
    r = np.random.default_rng(seed)
    made = lambda *shape: (r.standard_normal(shape) * (1.5 / shape[0]) ** 0.5).astype(np.float32)
    out = {"A": (r.standard_normal((FEATURES, INNER)) * 0.1).astype(np.float32), "a": np.zeros(INNER, np.float32), "O": made(2 * HIDDEN + INNER), "o": np.zeros(1, np.float32)}
    for d in "fb":
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1  # remember, at first
        out |= {f"W{d}": made(INNER, 4 * HIDDEN), f"U{d}": made(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(e: np.ndarray, there: np.ndarray, w: Weights, d: str, learning: bool = True) -> tuple[np.ndarray, list]:
    """States (time, page, HIDDEN) of one direction over e (time, page, INNER); there: 1 where a page has a block.

    Only learning asks for what every step had; without it a long page costs its states and no more.
    """
    steps, n, h = e.shape[0], e.shape[1], HIDDEN
    state, cell = np.zeros((n, h), e.dtype), np.zeros((n, h), e.dtype)
    out, kept = np.zeros((steps, n, h), np.float32), [None] * (steps if learning else 0)
    first = None
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        if t // SLICE != first:
            first = t // SLICE
            z = e[first * SLICE : (first + 1) * SLICE] @ w[f"W{d}"] + w[f"b{d}"]
        g = z[t - first * SLICE] + state @ w[f"U{d}"]
        gates, new = sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        m = there[t][:, None]
        c = (f * cell + i * new) * m
        tc = np.tanh(c)
        if learning:
            kept[t] = (state, cell, gates, new, tc, m)
        cell, state = c, o * tc * m
        out[t] = state
    return out, kept


def lstm_back(up: np.ndarray, e: np.ndarray, kept: list, w: Weights, d: str, grad: Weights) -> np.ndarray:
    """The gradient at e, for that at the states; what the weights get is added to grad."""
    steps, n, h = e.shape[0], e.shape[1], HIDDEN
    dz = np.zeros((steps, n, 4 * h), np.float32)
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    before = np.zeros((steps, n, h), np.float32)
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        state, cell, gates, new, tc, m = kept[t]
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        dh = (dh + up[t]) * m
        dc = (dc + dh * o * (1 - tc * tc)) * m
        dg = np.concatenate([dc * new, dc * cell, dh * tc], axis=1) * gates * (1 - gates)
        dz[t] = np.concatenate([dg, dc * i * (1 - new * new)], axis=1)
        before[t] = state
        dc = dc * f
        dh = dz[t] @ w[f"U{d}"].T
    grad[f"W{d}"] = e.reshape(-1, e.shape[2]).T @ dz.reshape(-1, 4 * h)
    grad[f"U{d}"] = before.reshape(-1, h).T @ dz.reshape(-1, 4 * h)
    grad[f"b{d}"] = dz.sum((0, 1))
    return dz @ w[f"W{d}"].T


def inner(x: np.ndarray, w: Weights) -> np.ndarray:
    return np.tanh(x @ w["A"] + w["a"])


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, width) and where there is a block."""
    steps = max(map(len, rows))
    x, there = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], there[: len(r), k] = r, 1
    return x, there


def read(e: np.ndarray, there: np.ndarray, w: Weights) -> np.ndarray:
    """How likely each block is part of the article, as a logit."""
    h, o = HIDDEN, w["O"]
    z = e @ o[2 * h :] + w["o"]
    for d, part in (("f", o[:h]), ("b", o[h : 2 * h])):
        z += lstm(e, there, w, d, learning=False)[0] @ part
    return z


@functools.lru_cache(maxsize=1)
def trained(made: int = MADE, seed: int = SEED) -> Weights:
    """The weights, by Adam on the cross-entropy of the blocks of made-up pages."""
    rnd = np.random.default_rng(seed)
    data = []
    for k in range(made):
        found = labelled(page(seed * 100_003 + k))
        if found[0]:
            data.append((features(found[0]), np.array(found[1], np.float32)))
    w = fresh(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for turn in range(PASSES):
        order = sorted(rnd.permutation(len(data)), key=lambda k: len(data[k][0]) // 8)
        for at in rnd.permutation(range(0, len(order), STEP)):
            rows = [data[k] for k in order[at : at + STEP]]
            x, there = padded([r[0] for r in rows])
            y, _ = padded([r[1][:, None] for r in rows])
            x[:, :, PATHS : PATHS + WORDS] *= (rnd.random((*there.shape, 1)) >= WITHHELD) / (1 - WITHHELD)
            e = inner(x, w)
            hf, kf = lstm(e, there, w, "f")
            hb, kb = lstm(e, there, w, "b")
            joined = np.concatenate([hf, hb, e], axis=2)
            up = (sigmoid(joined @ w["O"] + w["o"]) - y[:, :, 0]) * there / there.sum()
            grad: Weights = {"O": np.tensordot(up, joined, axes=([0, 1], [0, 1])), "o": np.array([up.sum()], np.float32)}
            de = up[:, :, None] * w["O"]
            h = HIDDEN
            total = de[:, :, 2 * h :] + lstm_back(np.ascontiguousarray(de[:, :, :h]), e, kf, w, "f", grad) + lstm_back(np.ascontiguousarray(de[:, :, h : 2 * h]), e, kb, w, "b", grad)
            total = total * (1 - e * e)
            grad["A"] = x.reshape(-1, FEATURES).T @ total.reshape(-1, INNER)
            grad["A"][PATHS : PATHS + WORDS] += PULL * w["A"][PATHS : PATHS + WORDS]
            grad["a"] = total.sum((0, 1))
            step += 1
            rate = RATE * (1 - turn / PASSES)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def labelled(made: tuple[str, set[str]]) -> tuple[list, list[bool]]:
    """The blocks of a made-up page, and whether each is among the texts of its article."""
    found = blocks(made[0])
    return found, [text in made[1] for text, _ in found]


def label(pages: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """For each page's vectors (blocks, INNER) whether a block is part of the article. Pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= PADDED:
            to += 1
        e, there = padded([pages[k] for k in order[at:to]])
        z = read(e, there, w)
        for j, k in enumerate(order[at:to]):
            out[k] = z[: len(pages[k]), j] > 0
        at = to
    return out


def vectored(found: list, w: Weights) -> np.ndarray:
    """The vectors (blocks, INNER) of a page's blocks, some at once; a block's place is that in the whole page."""
    parts = [inner(features(found[at : at + SLICE], at, len(found)), w) for at in range(0, max(len(found), 1), SLICE)]
    return np.concatenate(parts)


def main_texts(pages: list[str], w: Weights) -> list[str]:
    """The article of each page: its blocks in order, two line ends between them."""
    found = [blocks(p) for p in pages]
    vectors = [vectored(f, w) for f in found]
    return ["\n\n".join(text for (text, _), is_main in zip(f, chosen, strict=True) if is_main) for f, chosen in zip(found, label(vectors, w), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for each row of pages.

    A null or empty page has an empty text, as has one without a block that the labeller takes for the article. Pages are
    labelled one by one: ties, repeated rows and null ids need no rule, and an empty table gives none. Long pages are read
    whole. Other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(weights or trained())
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = T.StructType([named.schema["page_id"], named.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = main_texts(batch.column(2).to_pylist(), w)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return named.mapInArrow(run, schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
