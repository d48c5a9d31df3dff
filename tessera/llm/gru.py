"""A gated recurrent language model with a class-factored output softmax, in numpy: training by truncated backpropagation
and scoring.

The unit has an update gate and a candidate, both of the input and of the state before; the state's weights are one per
element, so that a step has no matrix product and the products of a window are done at once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np


@dataclass(frozen=True)
class Shape:
    """bounds: first rank of each output class of the words with vectors, and their number. Each tail class is an input and
    an output class without words of its own."""

    bounds: tuple[int, ...]
    tails: int
    embed: int = 16
    hidden: int = 32

    @property
    def head(self) -> int:
        return self.bounds[-1]

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1

    @property
    def inputs(self) -> int:
        return self.head + self.tails

    @property
    def outputs(self) -> int:
        return self.classes + self.tails

    @cached_property
    def class_of(self) -> np.ndarray:
        """Output class of each input number."""
        return np.r_[np.repeat(np.arange(self.classes), np.diff(self.bounds)), self.classes + np.arange(self.tails)].astype(np.int32)


def bounds_of(counts: np.ndarray, classes: int) -> tuple[int, ...]:
    """Cuts words in order of count into classes of about equal sums of the counts' square roots, which keeps both the
    number of classes and the words in an average token's class small."""
    root = np.cumsum(np.sqrt(counts + 1.0))
    cut = np.searchsorted(root, root[-1] * np.arange(1, classes) / classes) + 1
    return (0, *sorted({int(c) for c in cut if c < len(counts)}), len(counts))


def start(shape: Shape, counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters whose output biases are the smoothed frequencies of classes and of words in their classes; counts by input.

    Wz, bz and uz are the gate's, Wn, bn and un the candidate's; a word's output row has its bias at the end.
    """
    rng = np.random.default_rng(seed)
    e, h = shape.embed, shape.hidden
    normal = lambda scale, *n: (rng.standard_normal(n) * scale).astype(np.float32)
    smooth = counts.astype(float) + 0.5
    classes = np.bincount(shape.class_of, smooth, shape.outputs) + 1e-9
    words = np.zeros((shape.head, h + 1), np.float32)
    # a word's bias is its logarithm less that of the first of its class, the most frequent one
    words[:, h] = np.log(smooth[: shape.head] / smooth[np.repeat(shape.bounds[:-1], np.diff(shape.bounds))])
    return {
        "E": normal(0.3, shape.inputs, e), "Wz": normal(0.2, e, h), "Wn": normal(0.4, e, h), "uz": np.zeros(h, np.float32), "un": np.zeros(h, np.float32),
        # gates open at different rates, from the last word only to a long memory
        "bz": np.linspace(-3, 3, h).astype(np.float32), "bn": np.zeros(h, np.float32),
        "Wc": np.zeros((h, shape.outputs), np.float32), "bc": np.log(classes / classes.sum()).astype(np.float32), "Ww": words,
    }


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def lanes(docs: list[np.ndarray], n: int, bos: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deals documents to n lanes, longest first to the shortest lane: (inputs, targets, keep, place), each (n, steps), the longest
    lane first.

    The input before a document's first token is bos; keep is 0 there, so that its state starts from zero, and 1 elsewhere;
    place is the token's number in the concatenated documents, -1 where a lane has run out.
    """
    sizes = np.array([len(d) for d in docs])
    starts = np.r_[0, np.cumsum(sizes)]
    heap, dealt = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, k = heap[0]
        heapq.heapreplace(heap, (load + int(sizes[d]), k))
        dealt[k].append(d)
    loads = np.zeros(n, np.int64)
    for load, k in heap:
        loads[k] = load
    steps = int(loads.max()) if n else 0
    x, y, keep, place = np.full((n, steps), bos, np.int32), np.full((n, steps), bos, np.int32), np.ones((n, steps), np.float32), np.full((n, steps), -1, np.int32)
    # lanes that end early go last, so that steps can be narrowed
    for row, k in enumerate(np.argsort(-loads, kind="stable").tolist()):
        own = dealt[k]
        if not own:
            continue
        whole = np.concatenate([docs[d] for d in own])
        first = np.r_[0, np.cumsum(sizes[own])[:-1]]
        y[row, : len(whole)] = whole
        x[row, 1 : len(whole)] = whole[:-1]
        x[row, first] = bos
        keep[row, first] = 0
        place[row, : len(whole)] = np.arange(len(whole)) + np.repeat(starts[own] - first, sizes[own])
    return x, y, keep, place


def _tiled(row: np.ndarray, n: int) -> np.ndarray:
    """A row n times over: whole arrays meet in one loop, which broadcasting would cut into short ones."""
    return np.tile(row, (n, 1))


def _run(p: dict[str, np.ndarray], x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """A window of inputs from state h on: their embeddings, the states before each step, gates, candidates and the states after."""
    steps, n = x.shape
    size = h.shape[1]
    e = np.take(p["E"], x.ravel(), axis=0)
    # the candidate's tanh(v) is 1 - 2 s(-2 v), so that one function serves both; signs are turned beforehand
    z = (e @ -p["Wz"] - p["bz"]).reshape(steps, n, size)
    c = (e @ (2 * p["Wn"]) + 2 * p["bn"]).reshape(steps, n, size)
    uz, un = _tiled(-p["uz"], n), _tiled(2 * p["un"], n)
    before, after, add = np.empty_like(z), np.empty_like(z), np.empty_like(z[0])
    step, lane = np.nonzero(keep == 0)
    cuts = np.searchsorted(step, np.arange(steps + 1))
    for t in range(steps):
        b, s, g, v = before[t], after[t], z[t], c[t]
        b[:] = h
        if cuts[t + 1] > cuts[t]:
            b[lane[cuts[t] : cuts[t + 1]]] = 0
        np.multiply(b, uz, out=add)
        g += add
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(b, un, out=add)
        v += add
        np.exp(v, out=v)
        v += 1
        np.divide(-2, v, out=v)
        v += 1
        np.subtract(b, v, out=s)
        s *= g
        s += v
        h = s
    return e, before, z, c, after


@cache
def _ones(n: int, kind: np.dtype) -> np.ndarray:
    return np.ones(n, kind)


def _sums(q: np.ndarray) -> np.ndarray:
    return q @ _ones(q.shape[1], q.dtype)


def _sorted_by_class(shape: Shape, s: np.ndarray, c: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """Tokens of classes with two words or more, class by class: (their places, states with a one behind, places of the targets in
    their classes, and (from, to, first word, last word) of each class)."""
    order = np.argsort(c.astype(np.int16), kind="stable")
    ends = np.searchsorted(c[order], np.arange(shape.classes + 1)).tolist()
    order = order[: ends[-1]]
    so = np.ones((len(order), s.shape[1] + 1), s.dtype)
    so[:, :-1] = s[order]
    parts = [(ends[k], ends[k + 1], shape.bounds[k], shape.bounds[k + 1]) for k in range(shape.classes) if ends[k + 1] > ends[k] and shape.bounds[k + 1] - shape.bounds[k] > 1]
    local = target[order] - np.asarray(shape.bounds)[c[order]]
    return order, so, local, parts


def token_log10(p: dict[str, np.ndarray], shape: Shape, docs: list[np.ndarray], bos: int, width: int = 256, window: int = 8192) -> np.ndarray:
    """log10 of the model's probability of each token (tail tokens: of their class), for the concatenated documents.

    Windows, of about so many tokens, are a matter of memory only: the state is carried from each to the next, so whole
    documents are scored.
    """
    out = np.zeros(sum(map(len, docs)))
    x, y, keep, place = lanes(docs, min(width, max(1, len(docs))), bos)
    h, hi = np.zeros((len(x), shape.hidden), np.float32), 0
    while hi < x.shape[1]:
        live = int((place[:, hi] >= 0).sum())
        lo, hi = hi, hi + max(1, window // live)
        cut = np.s_[:live, lo:hi]
        states = _run(p, x[cut].T, keep[cut].T, h[:live])[-1]
        h = states[-1]
        where, target = place[cut].T.ravel(), y[cut].T.ravel()
        s = states.reshape(-1, shape.hidden)
        if where.min() < 0:
            ok = where >= 0
            s, where, target = s[ok], where[ok], target[ok]
        c = shape.class_of[target]
        logits = s @ p["Wc"]
        logits += p["bc"]
        got = logits[np.arange(len(c)), c].astype(float)
        np.exp(logits, out=logits)
        got -= np.log(_sums(logits))
        order, so, local, parts = _sorted_by_class(shape, s, c, target)
        inner = np.zeros(len(order))
        for i, j, a, b in parts:
            q = so[i:j] @ p["Ww"][a:b].T
            own = q[np.arange(j - i), local[i:j]]
            np.exp(q, out=q)
            inner[i:j] = own - np.log(_sums(q))
        got[order] += inner
        out[where] = got / np.log(10)
    return out


class Trainer:
    """Parameters under training: Adam for the unit and the class layer, Adagrad by row for words, whose rows most steps
    do not touch. Without train() the parameters stay as given."""

    DENSE = ("Wz", "Wn", "bz", "bn", "uz", "un", "Wc", "bc")

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, rate: float = 0.004, word_rate: float = 0.1):
        self.p, self.shape, self.rate, self.word_rate = {k: v.copy() for k, v in p.items()}, shape, rate, word_rate
        self.m = {k: np.zeros_like(p[k]) for k in self.DENSE}
        self.v = {k: np.zeros_like(p[k]) for k in self.DENSE}
        self.seen_in, self.seen_out = np.full(shape.inputs, 1e-8, np.float32), np.full(shape.head, 1e-8, np.float32)
        self.grad_out = np.zeros_like(p["Ww"])
        self.sizes = np.diff(shape.bounds)
        self.steps = 0

    def _adam(self, grad: dict[str, np.ndarray]) -> None:
        self.steps += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        for k in self.DENSE:
            g, m, v = grad[k], self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= rate * m / (np.sqrt(v) + 1e-8)

    def _classes(self, s: np.ndarray, c: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the class layer: by state, and by its parameters."""
        q = s @ self.p["Wc"]
        q += self.p["bc"]
        np.exp(q, out=q)
        q *= (weight / _sums(q))[:, None]
        q[np.arange(len(c)), c] -= weight
        return q @ self.p["Wc"].T, {"Wc": s.T @ q, "bc": np.ones(len(q), q.dtype) @ q}

    def _words(self, s: np.ndarray, c: np.ndarray, target: np.ndarray, ds: np.ndarray, weight: float) -> None:
        """Adds the gradient by state of words in their classes to ds and moves the words' rows. Words of one class stand
        together, so that a class is one product."""
        order, so, local, parts = _sorted_by_class(self.shape, s, c, target)
        words, grad = self.p["Ww"], self.grad_out
        grad[:] = 0
        back = np.zeros_like(so)
        for i, j, a, b in parts:
            q = so[i:j] @ words[a:b].T
            np.exp(q, out=q)
            q *= (weight / _sums(q))[:, None]
            q[np.arange(j - i), local[i:j]] -= weight
            np.matmul(q, words[a:b], out=back[i:j])
            np.matmul(q.T, so[i:j], out=grad[a:b])
        ds[order] += back[:, :-1]
        seen = self.seen_out
        seen += np.einsum("ij,ij->i", grad[:, :-1], grad[:, :-1]) / self.shape.hidden
        mean = np.add.reduceat(seen, self.shape.bounds[:-1]) / self.sizes
        grad *= (self.word_rate / np.sqrt(np.maximum(seen, np.repeat(mean, self.sizes))))[:, None]
        words -= grad

    def _backward(self, x: np.ndarray, keep: np.ndarray, e: np.ndarray, before: np.ndarray, z: np.ndarray, c: np.ndarray, ds: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the unit, and a step of the inputs' rows; the gradient stops at the window's start. z and c become the
        gradients of the gate and of the candidate before their functions."""
        p, size, n = self.p, self.shape.hidden, x.shape[1]
        uz, un = _tiled(p["uz"], n), _tiled(p["un"], n)
        through, slope, back = np.empty_like(before[0]), np.empty_like(before[0]), np.zeros_like(before[0])
        step, lane = np.nonzero(keep == 0)
        cuts = np.searchsorted(step, np.arange(len(x) + 1))
        for t in range(len(x) - 1, -1, -1):
            dh, g, v, b = ds[t], z[t], c[t], before[t]
            dh += back
            np.multiply(dh, g, out=through)
            np.subtract(b, v, out=back)
            # of the candidate: (dh - through) (1 - v v)
            dh -= through
            np.multiply(v, v, out=v)
            np.subtract(1, v, out=v)
            v *= dh
            # of the gate: through (b - candidate) (1 - g)
            np.subtract(1, g, out=g)
            g *= back
            g *= through
            np.multiply(g, uz, out=back)
            back += through
            np.multiply(v, un, out=slope)
            back += slope
            if cuts[t + 1] > cuts[t]:
                back[lane[cuts[t] : cuts[t + 1]]] = 0
        dz, dn, states = z.reshape(-1, size), c.reshape(-1, size), before.reshape(-1, size)
        one = np.ones(len(dz), dz.dtype)
        grad = {"Wz": e.T @ dz, "Wn": e.T @ dn, "bz": one @ dz, "bn": one @ dn}
        de = dz @ p["Wz"].T
        de += dn @ p["Wn"].T
        inputs = x.ravel()
        # numbers of 16 bits are sorted by radix
        order = np.argsort(inputs.astype(np.uint16) if self.shape.inputs <= 1 << 16 else inputs, kind="stable")
        sorted_ = inputs[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        used = sorted_[first]
        g = np.add.reduceat(np.take(de, order, axis=0), first)
        self.seen_in[used] += np.einsum("ij,ij->i", g, g) / self.shape.embed
        p["E"][used] -= (self.word_rate / np.sqrt(self.seen_in[used]))[:, None] * g
        dz *= states
        dn *= states
        return grad | {"uz": one @ dz, "un": one @ dn}

    def train(self, docs: list[np.ndarray], bos: int, width: int = 256, window: int = 32) -> None:
        """One pass over docs, a step for each window; the state is carried across windows of a document."""
        if not docs:
            return
        x, y, keep, place = lanes(docs, min(width, len(docs)), bos)
        size = self.shape.hidden
        h = np.zeros((len(x), size), np.float32)
        for lo in range(0, x.shape[1], window):
            live = int((place[:, lo] >= 0).sum())
            cut = np.s_[:live, lo : lo + window]
            inputs, kept = x[cut].T, keep[cut].T
            e, before, z, c, after = _run(self.p, inputs, kept, h[:live])
            h = after[-1].copy()
            s, target, there = after.reshape(-1, size), y[cut].T.ravel(), place[cut].T.ravel() >= 0
            share = 1 / int(there.sum())
            k = self.shape.class_of[target]
            ds, grad = self._classes(s, k, there.astype(np.float32) * np.float32(share))
            self._words(s, np.where(there, k, self.shape.classes), target, ds, np.float32(share))
            grad |= self._backward(inputs, kept, e, before, z, c, ds.reshape(before.shape))
            self._adam(grad)
