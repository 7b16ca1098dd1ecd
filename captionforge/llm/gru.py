"""A gated recurrent language model over word ids in numpy: lanes of documents, truncated backpropagation, class-factored softmax.

An id is a place in the tables of `Layout`: the end of a text, a frequent word, or a bucket of rarer words. p(word) is p(class)
times p(word | class). Classes of frequent words have a softmax of their own that the state moves; a rest class shares its
words' probability by their counts, and which rest class a word belongs to is told by its last bytes, so every word has one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
#: Lanes side by side, steps of a window: gradients go back so far, the state goes on.
LANES, WINDOW = 256, 32
#: Tokens whose classes are told at once.
BLOCK = 2048
RATE, SEED = 0.2, 5

Params = dict[str, np.ndarray]


@dataclass
class Layout:
    """By id: what goes in (input), the class, the place among its class's words (-1 in a rest class), and log p(word | rest class)."""

    inputs: np.ndarray
    classes: np.ndarray
    within: np.ndarray
    rest: np.ndarray
    #: first word of every class of frequent words, and after the last
    starts: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    n_inputs: int


def fresh(layout: Layout, seed: int = SEED) -> Params:
    """The output begins as the counts have it; only inputs are random."""
    r, h = np.random.default_rng(seed), HIDDEN
    some = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
    gates = some(0.1, layout.n_inputs, 3 * h)
    gates[:, 2 * h :] *= 4
    return {
        "E": gates,
        "G": some(0.1, h, 2 * h),
        "N": some(0.2, h, h),
        "g": np.zeros(2 * h, np.float32),
        "C": np.zeros((h, len(layout.class_bias)), np.float32),
        "c": layout.class_bias.astype(np.float32),
        "W": np.zeros((len(layout.word_bias), h), np.float32),
        "w": layout.word_bias.astype(np.float32),
    }


def no_squares(p: Params) -> Params:
    """Adagrad's sums before anything is learnt; rows of the word tables share one."""
    return {k: np.full(v.shape if v.ndim == 1 or k in "GNC" else (len(v), 1), 1e-8, np.float32) for k, v in p.items()}


def hold_memory() -> None:
    """Lets the C library keep what arrays of a step took for the next step's.

    It gives back, and takes page by page again, what exceeds twice the largest block that was freed so far; blocks above 32 MB don't count.
    """
    np.empty(31 << 20, np.uint8)


class Lanes:
    """Texts laid end to end in lanes of nearly equal length, the longest lane first. Flat, so a very long text costs its own length."""

    def __init__(self, texts: list[np.ndarray], most: int = LANES):
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        heap = [(0, j) for j in range(min(most, len(texts)))]
        own: list[list[int]] = [[] for _ in heap]
        for k in order:
            n, j = heap[0]
            own[j].append(k)
            heapq.heapreplace(heap, (n + len(texts[k]), j))
        own.sort(key=lambda ks: -sum(len(texts[k]) for k in ks))
        self.lengths = np.array([sum(len(texts[k]) for k in ks) for ks in own])
        self.starts = np.cumsum(self.lengths) - self.lengths
        laid = [k for ks in own for k in ks]
        sizes = np.array([len(texts[k]) for k in laid])
        self.ids = np.concatenate([texts[k] for k in laid])
        self.which = np.repeat(np.array(laid, np.int32), sizes)
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.cumsum(sizes) - sizes] = True

    def windows(self, window: int):
        """(lanes there, ids, text numbers, starts, which steps hold a token) by (step, lane), for one stretch after another."""
        for at in range(0, int(self.lengths[0]), window):
            n = int((self.lengths > at).sum())
            left = self.lengths[:n] - at
            steps = np.arange(min(window, int(left[0])))[:, None]
            there = steps < left
            place = self.starts[:n] + at + np.minimum(steps, left - 1)
            yield n, self.ids[place], self.which[place], self.first[place], there


def beginnings(keep: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The lanes where a text starts, step after step, and where in these each step's begin."""
    step, lane = np.nonzero(keep[:, :, 0] == 0)
    return np.searchsorted(step, np.arange(len(keep) + 1)).tolist(), lane


def forward(p: Params, e: np.ndarray, keep: np.ndarray, state: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The state before each step (time, lane, HIDDEN), and after the last. e: the inputs' rows of E; keep: 0 where a text starts.

    Both gates of a step lie one after the other, (2, lane, HIDDEN), so that nothing goes over parts of rows.
    """
    h, n, (steps, lanes) = HIDDEN, p["N"], e.shape[:2]
    # sigmoid(x) = 1 / (1 + exp(-x)): signs are turned before the steps
    g = np.stack([-p["G"][:, :h], -p["G"][:, h:]])
    gates = np.empty((steps, 2, lanes, h), np.float32)
    np.subtract(-p["g"][:h], e[:, :, :h], out=gates[:, 0])
    np.subtract(-p["g"][h:], e[:, :, h : 2 * h], out=gates[:, 1])
    news = np.ascontiguousarray(e[:, :, 2 * h :])
    out = np.empty((steps, lanes, h), np.float32)
    # without gradients a step's products and moves are written over those of the step before
    resets, moves = (np.empty((steps if kept is not None else 1, lanes, h), np.float32) for _ in "rm")
    product, own = np.empty((2, lanes, h), np.float32), np.empty((lanes, h), np.float32)
    begin, lane = beginnings(keep)
    with np.errstate(over="ignore"):
        for t in range(steps):
            at = t if kept is not None else 0
            before, zr, reset, new, move = out[t], gates[t], resets[at], news[t], moves[at]
            before[:] = state
            if begin[t] < begin[t + 1]:
                before[lane[begin[t] : begin[t + 1]]] = 0
            np.matmul(before, g, out=product)
            zr += product
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[1], before, out=reset)
            new += np.matmul(reset, n, out=own)
            np.tanh(new, out=new)
            np.subtract(new, before, out=move)
            move *= zr[0]
            state = before + move
    if kept is not None:
        kept.append((gates, resets, news, moves))
    return out, state


def backward(p: Params, up: np.ndarray, out: np.ndarray, keep: np.ndarray, kept: list, grad: Params) -> np.ndarray:
    """The gradient at e, for that at the states; grad gets those of the recurrent weights."""
    h, (gates, resets, news, moves), (begin, lane) = HIDDEN, kept[-1], beginnings(keep)
    to_z, to_r, to_n = (np.ascontiguousarray(x.T) for x in (p["G"][:, :h], p["G"][:, h:], p["N"]))
    dz, dr, dn = (np.empty_like(out) for _ in range(3))
    d, own, kept_d, at_reset = (np.zeros(out.shape[1:], np.float32) for _ in range(4))
    for t in range(out.shape[0] - 1, -1, -1):
        (z, r), new = gates[t], news[t]
        # d goes to the new state by z, to the old one by 1 - z
        np.multiply(d, z, out=own)
        np.subtract(d, own, out=kept_d)
        np.multiply(kept_d, moves[t], out=dz[t])
        np.multiply(new, new, out=dn[t])
        np.subtract(1, dn[t], out=dn[t])
        dn[t] *= own
        np.matmul(dn[t], to_n, out=at_reset)
        np.multiply(at_reset, r, out=own)
        np.subtract(at_reset, own, out=at_reset)
        np.multiply(at_reset, resets[t], out=dr[t])
        np.add(kept_d, own, out=d)
        d += np.matmul(dz[t], to_z, out=own)
        d += np.matmul(dr[t], to_r, out=own)
        d += up[t]
        if begin[t] < begin[t + 1]:
            d[lane[begin[t] : begin[t + 1]]] = 0
    dz, dr, dn = (x.reshape(-1, h) for x in (dz, dr, dn))
    states, ones = out.reshape(-1, h).T, np.ones(len(dz), np.float32)
    grad["G"] = np.concatenate([states @ dz, states @ dr], axis=1)
    grad["N"] = resets.reshape(-1, h).T @ dn
    grad["g"] = np.concatenate([ones @ dz, ones @ dr])
    return np.concatenate([dz, dr, dn], axis=1).reshape(*out.shape[:2], 3 * h)


def shares(z: np.ndarray, place: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of z the value at place (in z laid flat), and the sum of exp(z). z becomes exp(z); where it could overflow, rows are first lowered to at most zero."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    own = z.reshape(-1)[place]
    np.exp(z, out=z)
    return own, z @ np.ones(z.shape[1], np.float32)


def predict(p: Params, layout: Layout, state: np.ndarray, ids: np.ndarray, grad: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log p of each id, given the state before it; with grad also the gradient of the mean loss at the states."""
    n, h, c = len(ids), HIDDEN, layout.classes[ids]
    # states are within -1 and 1, so this bounds every logit
    bounded = max(np.abs(p["C"]).sum(0).max() + np.abs(p["c"]).max(), np.abs(p["W"]).sum(1).max() + np.abs(p["w"]).max()) < 60
    n_classes, n_own = len(p["c"]), len(layout.starts) - 1
    # a column of ones takes the biases
    state, plain = np.ones((n, h + 1), np.float32), state
    state[:, :h] = plain
    to_class, to_word = np.concatenate([p["C"], p["c"][None]]), np.concatenate([p["W"], p["w"][:, None]], axis=1)
    logp, up = layout.rest[ids], None
    if grad is not None:
        up, from_class, at_class = np.empty((n, h), np.float32), np.ascontiguousarray(p["C"].T), np.zeros((h + 1, n_classes), np.float32)
        grad["W"], grad["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
    buffer, steps = np.empty((min(n, BLOCK), n_classes), np.float32), np.arange(max(n, 1), dtype=np.int64)
    for lo in range(0, n, BLOCK):
        s = state[lo : lo + BLOCK]
        z = np.matmul(s, to_class, out=buffer[: len(s)])
        place = steps[: len(s)] * n_classes + c[lo : lo + BLOCK]
        own, total = shares(z, place, bounded)
        logp[lo : lo + BLOCK] += own - np.log(total)
        if grad is not None:
            z.reshape(-1)[place] -= total
            part = 1 / (n * total)
            at_class += (s * part[:, None]).T @ z
            np.multiply(z @ from_class, part[:, None], out=up[lo : lo + BLOCK])
    if grad is not None:
        grad["C"], grad["c"] = at_class[:h].copy(), at_class[h].copy()

    order = np.argsort(c.astype(np.int16), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(n_own + 1)).tolist()
    order = order[: bounds[-1]]
    within, state, found = layout.within[ids[order]], state.take(order, 0), np.zeros(len(order), np.float32)
    ups = np.zeros((len(order), h), np.float32) if grad is not None else None
    for k, (lo, hi) in enumerate(zip(layout.starts[:-1].tolist(), layout.starts[1:].tolist(), strict=True)):
        a, b = bounds[k : k + 2]
        if a == b or hi - lo < 2:
            continue
        s, place = state[a:b], steps[: b - a] * (hi - lo) + within[a:b]
        z = s @ to_word[lo:hi].T
        own, total = shares(z, place, bounded)
        found[a:b] = own - np.log(total)
        if grad is not None:
            z.reshape(-1)[place] -= total
            part = 1 / (n * total)
            grad["W"][lo:hi], grad["w"][lo:hi] = z.T @ (s[:, :h] * part[:, None]), part @ z
            np.multiply(z @ p["W"][lo:hi], part[:, None], out=ups[a:b])
    logp[order] += found
    if grad is not None:
        up[order] = up.take(order, 0) + ups
    return logp, up


def sums_by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, sorted, and the sums of their values: neighbours are added up, then neighbours of these, and so on."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values.take(order, 0)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    left = np.arange(len(rows)) - np.repeat(starts, sizes)
    # by place in values, the number within its row; those that haven't been added to another yet
    at = np.flatnonzero(left)
    left, far = left[at], 1
    while len(at):
        odd = (left & 1).astype(bool)
        given = at[odd]
        to = given - far
        values[to] = values.take(to, 0) + values.take(given, 0)
        at, left, far = at[~odd], left[~odd] >> 1, 2 * far
    return rows[starts], values.take(starts, 0)


def mean_square(g: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])


class Learner:
    """Adagrad over the windows of texts. Gradients go back within a window; a text's state goes on from its first token to its last."""

    def __init__(self, p: Params, layout: Layout, squares: Params | None = None, rate: float = RATE):
        self.p, self.layout, self.rate, self.tokens = {k: v.copy() for k, v in p.items()}, layout, rate, 0
        self.squares = {k: v.copy() for k, v in (squares or no_squares(p)).items()}

    def learn(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        hold_memory()
        laid, state, most = Lanes(texts), None, 0
        self.tokens += len(laid.ids)
        for n, ids, _, first, there in laid.windows(WINDOW):
            state = np.zeros((n, HIDDEN), np.float32) if state is None else state[:n]
            # where long texts go on alone, a window counts by its tokens
            tokens = int(there.sum())
            most = max(most, tokens)
            state = self.step(ids, first, there, state, tokens / most)

    def step(self, ids: np.ndarray, first: np.ndarray, there: np.ndarray, state: np.ndarray, weight: float = 1.0) -> np.ndarray:
        p, grad, kept = self.p, {}, []
        inputs = self.layout.inputs[ids]
        keep = (~first)[:, :, None].astype(np.float32)
        out, last = forward(p, p["E"].take(inputs, 0), keep, state, kept)
        if there.all():
            _, up = predict(p, self.layout, out.reshape(-1, HIDDEN), ids.ravel(), grad)
            full = up.reshape(out.shape)
        else:
            _, up = predict(p, self.layout, out[there], ids[there], grad)
            full = np.zeros_like(out)
            full[there] = up
        if weight != 1:
            full *= np.float32(weight)
            for k in ("C", "c", "W", "w"):
                grad[k] *= np.float32(weight)
        de = backward(p, full, out, keep, kept, grad)
        self.apply_rows("E", inputs.ravel(), de.reshape(-1, 3 * HIDDEN))
        for k in ("G", "N", "g", "C", "c"):
            self.squares[k] += grad[k] * grad[k]
            p[k] -= self.rate * grad[k] / np.sqrt(self.squares[k])
        s, g = self.squares["W"], grad["W"]
        s[:, 0] += mean_square(g)
        g *= self.rate / np.sqrt(s)
        p["W"] -= g
        self.squares["w"] += grad["w"] * grad["w"]
        p["w"] -= 0.3 * self.rate * grad["w"] / np.sqrt(self.squares["w"])
        return last

    def apply_rows(self, name: str, rows: np.ndarray, values: np.ndarray) -> None:
        own, g = sums_by_row(rows.astype(np.uint16) if self.layout.n_inputs < 65_536 else rows, values)
        s = self.squares[name]
        s[own, 0] += mean_square(g)
        g *= self.rate / np.sqrt(s[own])
        self.p[name][own] -= g


def score(p: Params, layout: Layout, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log p of every text, its state carried from its first token to its last."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    hold_memory()
    state = None
    for n, ids, which, first, there in Lanes(texts).windows(2 * WINDOW):
        state = np.zeros((n, HIDDEN), np.float32) if state is None else state[:n]
        states, state = forward(p, p["E"].take(layout.inputs[ids], 0), (~first)[:, :, None].astype(np.float32), state)
        if not there.all():
            states, ids, which = states[there], ids[there], which[there]
        logp, _ = predict(p, layout, states.reshape(-1, HIDDEN), ids.ravel())
        out += np.bincount(which.ravel(), weights=logp, minlength=len(texts))
    return out
