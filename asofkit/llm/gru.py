"""A small gated recurrent network over words in numpy: truncated backpropagation, and scoring of whole documents.

The input is the previous word's embedding, one row for each gate. The output is factored by classes: a softmax on the state gives the
class, another one, over the words of that class alone, the word. Words are numbered by frequency and classes hold
neighbours: many small classes for frequent words, larger ones for rarer words, so that few outputs are worked out for each word.

Documents of any length and number may be given: they run in lanes side by side, a window at a time, and memory follows the
tokens given, not the longest document. An empty list scores nothing and trains nothing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

HIDDEN, WINDOW, LANES, SEGMENT = 12, 16, 512, 1024
#: Sizes of the classes of words in order of frequency: (classes, words in each); the rest goes to classes of REST words.
TIERS, REST = ((16, 16), (32, 64)), 256
F32 = np.float32


class Vocabulary(NamedTuple):
    """Words 0: the tail, 1..head by frequency, head + 1: the end. Classes 0: the end, 1: the tail, from 2 on those of the head."""

    head: int
    cls: np.ndarray  # of each word
    first: np.ndarray  # of each class of the head, its first row in the table of outputs; row: word - 1
    width: np.ndarray  # its rows (those beyond the head are padding)

    @property
    def rows(self) -> int:
        return int(self.first[-1] + self.width[-1]) if len(self.first) else 0


def vocabulary(head: int) -> Vocabulary:
    first, width, at = [], [], 0
    for n, size in (*TIERS, (head, REST)):
        while n and at < head:
            first.append(at)
            width.append(size)
            at, n = at + size, n - 1
    first, width = np.array(first, np.int64), np.array(width, np.int64)
    cls = np.zeros(head + 2, np.int64)
    cls[0] = 1
    cls[1 : head + 1] = np.searchsorted(first, np.arange(head), side="right") + 1
    return Vocabulary(head, cls, first, width)


class Model:
    """Weights, what the optimizer holds of them, and how often each word was an input (in) and its class a target (out)."""

    def __init__(self, v: Vocabulary, dense: dict[str, np.ndarray], e: np.ndarray, w: np.ndarray):
        """e: a row for each word, 3 x HIDDEN and the sum of squares; w: a row for each output, HIDDEN, a bias and the sum of squares."""
        self.v, self.dense, self.e, self.w = v, dense, e, w
        self.m, self.s = ({k: np.zeros_like(x) for k, x in dense.items()} for _ in range(2))
        self.step = self.tokens = 0
        self.seen_e, self.seen_w = np.zeros(len(e), F32), np.zeros(len(w), F32)


def initial(v: Vocabulary, counts: np.ndarray, seed: int = 10) -> Model:
    """Small random weights, biases from the counts of the words (0..head + 1): it starts as a unigram model."""
    r = np.random.default_rng(seed)
    mass = np.bincount(v.cls, counts, len(v.first) + 2) + 0.5
    dense = {"u": r.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), "n": np.zeros(HIDDEN), "o": np.vstack([r.normal(0, 0.05, (HIDDEN, len(mass))), np.log(mass / mass.sum())])}
    e = np.hstack([r.normal(0, 0.4, (v.head + 2, 3 * HIDDEN)), np.full((v.head + 2, 1), 1e-6)])
    w = np.zeros((v.rows, HIDDEN + 2))
    w[:, -1] = 1e-6
    w[:, -2] = -1e9  # padding
    w[: v.head, -2] = np.log(np.maximum(counts[1 : v.head + 1], 0.5))
    return Model(v, {k: x.astype(F32) for k, x in dense.items()}, e.astype(F32), w.astype(F32))


def blocks(docs: list[np.ndarray], end: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut into rows of `window` tokens: previous token, target (-1: none), document and whether it is a document's first row."""
    sizes = np.array([len(d) for d in docs], np.int64)
    rows = -(-sizes // window)
    start = (np.cumsum(rows) - rows) * window
    flat = np.concatenate([np.asarray(d, np.int32) for d in docs])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
    target = np.full(int(rows.sum()) * window, -1, np.int32)
    target[place] = flat
    previous = np.full(len(target), end, np.int32)
    inner = place[:-1][np.diff(np.repeat(np.arange(len(docs)), sizes)) == 0]
    previous[inner + 1] = target[inner]
    doc = np.repeat(np.arange(len(docs)), rows)
    fresh = np.zeros(len(doc), bool)
    fresh[start // window] = True
    return previous.reshape(-1, window), target.reshape(-1, window), doc, fresh


def schedule(doc: np.ndarray, lanes: int) -> Iterator[np.ndarray]:
    """Rows that run side by side, a document in one lane from its first row to its last; lanes that have ended are left out at the end."""
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rows = np.diff(np.append(starts, len(doc)))
    lanes = int(max(1, min(lanes, len(rows), max(64, rows.sum() // rows.max()))))
    heap = [(0, i) for i in range(lanes)]
    dealt: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    for i in np.argsort(-rows, kind="stable").tolist():
        n, lane = heap[0]
        dealt[lane].append(np.arange(starts[i], starts[i] + rows[i]))
        heapq.heapreplace(heap, (n + int(rows[i]), lane))
    lists = sorted((np.concatenate(d) for d in dealt), key=len, reverse=True)
    lengths = np.array([len(x) for x in lists])
    table = np.zeros((len(lists), lengths[0]), np.int64)
    for i, x in enumerate(lists):
        table[i, : len(x)] = x
    for t in range(lengths[0]):
        yield table[: np.count_nonzero(lengths > t), t]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(model: Model, h: np.ndarray, previous: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps x lanes x HIDDEN) after each of the previous words (steps x lanes), from h on. keep gets what backpropagation needs."""
    u, bias, x = model.dense["u"], model.dense["n"], model.e[previous, : 3 * HIDDEN]
    out = np.empty((*previous.shape, HIDDEN), F32)
    for t in range(len(previous)):
        a = h @ u
        g = _sigmoid(x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        rec = a[:, 2 * HIDDEN :]
        rec += bias
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * rec)
        if keep is not None:
            keep.append((h, z, r, rec, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def _exp(x: np.ndarray) -> np.ndarray:
    """The shift of each row (0 as a rule) that keeps its exponentials finite; x becomes those."""
    shift = np.zeros(len(x), F32)
    if x.size and x.max() > 60:
        shift = x.max(axis=1)
        x -= shift[:, None]
    np.exp(x, out=x)
    return shift


class Outputs:
    """Log probabilities of target words given states with a 1 behind them, and the gradients of their negative sum."""

    def __init__(self, model: Model, s: np.ndarray, target: np.ndarray, train: bool):
        v, n, o = model.v, np.arange(len(target)), model.dense["o"]
        cls = v.cls[target]
        e = s @ o
        chosen = e[n, cls]
        shift = _exp(e)
        total = e @ np.ones(e.shape[1], F32)
        self.log_p = chosen - shift - np.log(total)
        if train:
            e[n, cls] -= total  # so that e / total is the gradient
            self.d_o = (s / total[:, None]).T @ e
            self.d_s = e @ o[:-1].T
            self.d_s /= total[:, None]
            self.d_w = np.zeros((len(model.w), HIDDEN + 1), F32)
        order = np.argsort(cls, kind="stable")
        order = order[np.searchsorted(cls[order], 2) :]
        sorted_ = cls[order] - 2
        bounds = np.searchsorted(sorted_, np.arange(len(v.first) + 1)).tolist()
        own = s[order]
        w = np.ascontiguousarray(model.w[:, : HIDDEN + 1])
        first = v.first.tolist()
        for width in np.unique(v.width).tolist():  # classes of one width lie together
            mine = [c for c in np.flatnonzero(v.width == width).tolist() if bounds[c] < bounds[c + 1]]
            if not mine:
                continue
            lo, hi = bounds[mine[0]], bounds[mine[-1] + 1]
            e = np.empty((hi - lo, width), F32)
            for c in mine:
                np.matmul(own[bounds[c] : bounds[c + 1]], w[first[c] : first[c] + width].T, out=e[bounds[c] - lo : bounds[c + 1] - lo])
            at, place = np.arange(hi - lo), target[order[lo:hi]] - 1 - v.first[sorted_[lo:hi]]
            chosen = e[at, place]
            shift = _exp(e)
            total = e @ np.ones(width, F32)
            self.log_p[order[lo:hi]] += chosen - shift - np.log(total)
            if train:
                e[at, place] -= total
                scaled = own[lo:hi] / total[:, None]
                d_own = np.empty((hi - lo, HIDDEN + 1), F32)
                for c in mine:
                    a, b, rows = bounds[c] - lo, bounds[c + 1] - lo, slice(first[c], first[c] + width)
                    np.matmul(e[a:b].T, scaled[a:b], out=self.d_w[rows])
                    np.matmul(e[a:b], w[rows], out=d_own[a:b])
                    model.seen_w[rows] += b - a
                self.d_s[order[lo:hi]] += d_own[:, :-1] / total[:, None]


def with_one(s: np.ndarray) -> np.ndarray:
    return np.concatenate([s.reshape(-1, HIDDEN), np.ones((s.size // HIDDEN, 1), F32)], axis=1)


def score(model: Model, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log probability of each document's words, the state carried from window to window."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    previous, target, doc, fresh = blocks(docs, model.v.head + 1)
    h, held, size = np.zeros((lanes, HIDDEN), F32), [], 0

    def add() -> None:
        s, t, d = (np.concatenate(x) for x in zip(*held, strict=True))
        ok = t >= 0
        out[:] += np.bincount(d[ok], Outputs(model, with_one(s)[ok], t[ok], False).log_p, len(docs))

    for rows in schedule(doc, lanes):
        h = h[: len(rows)] * ~fresh[rows, None]
        s = states(model, h, previous[rows].T)
        h = s[-1]
        held.append((s.reshape(-1, HIDDEN), target[rows].T.ravel(), np.tile(doc[rows], WINDOW)))
        size += s.size
        if size >= HIDDEN * LANES * WINDOW:  # outputs of many tokens at once, also where few lanes run
            add()
            held, size = [], 0
    if held:
        add()
    return out


def _by_word(words: np.ndarray, rows: np.ndarray, many: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and the sums of their rows: of up to `many` rows together for all words, of more rows word by word."""
    order = np.argsort(words, kind="stable")
    distinct, starts, times = np.unique(words[order], return_index=True, return_counts=True)
    out = rows[order[starts]]
    for k in range(1, many):
        some = np.flatnonzero((times > k) & (times <= many))
        if not len(some):
            break
        out[some] += rows[order[starts[some] + k]]
    for i in np.flatnonzero(times > many).tolist():
        out[i] = rows[order[starts[i] : starts[i] + times[i]]].sum(axis=0)
    return distinct, out


def gradients(model: Model, h: np.ndarray, previous: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Last states, the sum of log probabilities, and of the latter's negative: gradients of the dense weights and of the outputs, words, and gradients of their embeddings."""
    steps, lanes = previous.shape
    keep: list[tuple] = []
    s = states(model, h, previous, keep)
    flat, t = with_one(s), target.ravel()
    ok = t >= 0
    found = Outputs(model, flat[ok], t[ok], True)
    d_s = np.zeros((steps * lanes, HIDDEN), F32)
    d_s[ok] = found.d_s
    d_s = d_s.reshape(steps, lanes, HIDDEN)
    d_x = np.empty((steps, lanes, 3 * HIDDEN), F32)
    d_gates = np.empty_like(d_x)
    dh, u_t = np.zeros((lanes, HIDDEN), F32), model.dense["u"].T
    for i in range(steps - 1, -1, -1):
        before, z, r, rec, n = keep[i]
        dh = dh + d_s[i]
        dn = dh * (1 - z) * (1 - n * n)
        d_x[i, :, :HIDDEN] = dh * (before - n) * z * (1 - z)
        d_x[i, :, HIDDEN : 2 * HIDDEN] = dn * rec * r * (1 - r)
        d_x[i, :, 2 * HIDDEN :] = dn
        d_gates[i] = d_x[i]
        d_gates[i, :, 2 * HIDDEN :] *= r
        dh = dh * z + d_gates[i] @ u_t
    g, b = d_gates.reshape(-1, 3 * HIDDEN), np.stack([k[0] for k in keep]).reshape(-1, HIDDEN)
    dense = {"u": b.T @ g, "n": g[:, 2 * HIDDEN :].sum(axis=0), "o": found.d_o}
    return s[-1], float(found.log_p.sum()), dense, found.d_w, *_by_word(previous.ravel(), d_x.reshape(-1, 3 * HIDDEN))


def train(model: Model, docs: list[np.ndarray], rate: float, word_rate: float, lanes: int = LANES) -> float:
    """One pass over the documents, model changed in place; the sum of log probabilities on the way.

    Backpropagation is cut at each window, the state goes on. Long documents are cut into segments, so that lanes stay full. Adam for
    the dense weights, steps divided by the root of the sum of squares for each word's rows."""
    if not docs:
        return 0.0
    docs = [d[a : a + SEGMENT] for d in docs for a in range(0, max(1, len(d)), SEGMENT)]
    previous, target, doc, fresh = blocks(docs, model.v.head + 1)
    h, total = np.zeros((lanes, HIDDEN), F32), 0.0
    for rows in schedule(doc, lanes):
        h = h[: len(rows)] * ~fresh[rows, None]
        t = target[rows].T
        h, log_p, dense, d_w, words, d_e = gradients(model, h, previous[rows].T, t)
        n = int(np.count_nonzero(t >= 0))
        total += log_p
        model.tokens += n
        model.step += 1
        share = min(1.0, n / (lanes * WINDOW / 4))  # smaller steps where few lanes are left
        for k, g in dense.items():
            g = g / F32(max(n, 1))
            model.m[k] += F32(0.1) * (g - model.m[k])
            model.s[k] += F32(0.01) * (g * g - model.s[k])
            model.dense[k] -= F32(rate * share) * (model.m[k] / F32(1 - 0.9**model.step)) / (np.sqrt(model.s[k] / F32(1 - 0.99**model.step)) + F32(1e-5))
        model.w[:, -1] += np.einsum("ij,ij->i", d_w, d_w)
        d_w *= (F32(word_rate) / np.sqrt(model.w[:, -1]))[:, None]
        model.w[:, :-1] -= d_w
        own = model.e[words]
        own[:, -1] += np.einsum("ij,ij->i", d_e, d_e)
        d_e *= (F32(word_rate) / np.sqrt(own[:, -1]))[:, None]
        own[:, :-1] -= d_e
        model.e[words] = own
        model.seen_e[words] += 1
    return total
