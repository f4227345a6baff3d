"""A gated recurrent network over class sequences, in numpy: training by truncated backpropagation, and scoring."""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
LANES = 256           # documents that run side by side
STEPS = 16            # steps that gradients flow back; the state flows on
RATE, CLIP = 0.01, 1.0


class Gru:
    """p(class | all classes before it in the document). Parameters are one flat float32 vector."""

    def __init__(self, classes: int, hidden: int = HIDDEN, flat: np.ndarray | None = None):
        self.classes, self.hidden = classes, hidden
        self.shapes = {"x": (classes, 3 * hidden), "u": (hidden, 3 * hidden), "b": (3 * hidden,), "o": (hidden, classes), "c": (classes,)}
        size = sum(int(np.prod(s)) for s in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.p = self.views(self.flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at:at + n].reshape(s)
            at += n
        return out

    @classmethod
    def fresh(cls, prior: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Gru:
        """Starts at the class shares ``prior``, whatever came before."""
        g = cls(len(prior), hidden)
        rng = np.random.default_rng(seed)
        for k in ("x", "u", "o"):
            g.p[k][:] = rng.normal(0, 0.3 if k != "o" else 0.02, g.shapes[k])
        g.p["b"][:hidden] = 1.0                                 # keeps its state at first
        g.p["c"][:] = np.log(prior)
        return g

    def window(self, state: np.ndarray, seen: np.ndarray, fresh: np.ndarray):
        """Run steps of lanes: ``seen`` (steps, lanes) the class before each, ``fresh`` where a document starts.

        Arrays are feature-major, (features, lanes), so that gates are contiguous. ``state`` is (hidden, lanes).
        Returns the last state, what backpropagation needs, the states and the log-probabilities of all classes.
        """
        p, n = self.p, self.hidden
        steps, width = seen.shape
        by_class = np.ascontiguousarray((p["x"] + p["b"]).T)
        back = np.ascontiguousarray(p["u"].T)
        kind = self.flat.dtype
        before, after, new = (np.empty((steps, n, width), kind) for _ in range(3))
        gates, inner = np.empty((steps, 2 * n, width), kind), np.empty((steps, n, width), kind)
        any_fresh = fresh.any(axis=1)
        h = state
        for t in range(steps):
            if any_fresh[t]:
                h = h * ~fresh[t]
            before[t] = h
            x = by_class.take(seen[t], axis=1)
            g = back @ h
            a = gates[t]
            np.add(x[:2 * n], g[:2 * n], out=a)
            np.negative(a, out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            inner[t] = g[2 * n:]
            c = new[t]
            np.multiply(a[n:], g[2 * n:], out=c)
            c += x[2 * n:]
            np.tanh(c, out=c)
            np.subtract(h, c, out=after[t])
            after[t] *= a[:n]
            after[t] += c
            h = after[t]
        logits = np.matmul(np.ascontiguousarray(p["o"].T), after)
        logits += p["c"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return h, (before, gates, new, inner), after, logits

    def gradient(self, kept, after, logits, seen, fresh, target, weight) -> np.ndarray:
        """Of the mean negative log-likelihood of ``target`` with ``weight``, back to the window's first step."""
        p, n = self.p, self.hidden
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        before, gates, new, inner = kept
        every = np.arange(self.classes)[None, :, None]
        d = np.exp(logits)
        d -= every == target[:, None, :]
        d *= (weight / max(1.0, weight.sum()))[:, None, :]
        g["o"] += np.matmul(after, d.transpose(0, 2, 1)).sum(axis=0)
        g["c"] += d.sum(axis=(0, 2))
        out = np.matmul(p["o"], d)
        any_fresh = fresh.any(axis=1)
        dx = np.empty((len(seen), 3 * n, seen.shape[1]), self.flat.dtype)
        dg = np.empty_like(dx)
        dh = np.zeros_like(out[0])
        for t in range(len(seen) - 1, -1, -1):
            z, r, c = gates[t, :n], gates[t, n:], new[t]
            dh += out[t]
            dn = dh * (1 - z)
            dn *= 1 - c * c
            np.multiply(dh * (before[t] - c), z * (1 - z), out=dx[t, :n])
            np.multiply(dn * inner[t], r * (1 - r), out=dx[t, n:2 * n])
            dx[t, 2 * n:] = dn
            dg[t, :2 * n] = dx[t, :2 * n]
            np.multiply(dn, r, out=dg[t, 2 * n:])
            dh *= z
            dh += p["u"] @ dg[t]
            if any_fresh[t]:
                dh *= ~fresh[t]
        g["u"] += np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
        g["b"] += dx.sum(axis=(0, 2))
        g["x"] += np.matmul((every == seen[:, None, :]).astype(self.flat.dtype), dx.transpose(0, 2, 1)).sum(axis=0)
        return flat


def lanes(docs: list[np.ndarray], count: int = LANES):
    """Documents dealt to lanes, longest first: (classes, fresh, lengths, places), lanes by falling length.

    ``classes`` and ``fresh`` are (steps, lanes); ``places`` gives each document's lane and first step.
    """
    heap = [(0, k) for k in range(max(1, min(count, len(docs))))]
    held: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    total = {k: size for size, k in heap}
    order = sorted(total, key=lambda k: -total[k])
    lengths = np.array([total[k] for k in order])
    classes = np.zeros((int(lengths.max(initial=0)), len(order)), np.uint8)
    fresh = np.zeros(classes.shape, bool)
    places = [(0, 0)] * len(docs)
    for lane, k in enumerate(order):
        at = 0
        for i in held[k]:
            classes[at:at + len(docs[i]), lane] = docs[i]
            fresh[at, lane] = True
            places[i] = (lane, at)
            at += len(docs[i])
    return classes, fresh, lengths, places


def _windows(gru: Gru, docs: list[np.ndarray], end: int):
    """Windows over lanes, the state carried from one to the next: what ``window`` gives, and the weights."""
    classes, fresh, lengths, places = lanes(docs)
    state = np.zeros((gru.hidden, classes.shape[1]), np.float32)
    before = np.concatenate([np.full((1, classes.shape[1]), end, np.uint8), classes[:-1]])
    for t in range(0, len(classes), STEPS):
        active = int((lengths > t).sum())
        rows = slice(t, t + STEPS)
        target, seen, new = classes[rows, :active], before[rows, :active], fresh[rows, :active]
        weight = (np.arange(t, t + len(target))[:, None] < lengths[None, :active]).astype(np.float32)
        state, kept, hs, logits = gru.window(np.ascontiguousarray(state[:, :active]), seen, new)
        yield t, active, target, seen, new, weight, kept, hs, logits


def learn(gru: Gru, docs: list[np.ndarray], end: int, memory: dict) -> None:
    """One pass over ``docs`` by Adam; ``memory`` keeps its moments between calls."""
    m, v = (memory.setdefault(k, np.zeros_like(gru.flat)) for k in "mv")
    for _, _, target, seen, new, weight, kept, hs, logits in _windows(gru, docs, end):
        g = gru.gradient(kept, hs, logits, seen, new, target, weight)
        g *= min(1.0, CLIP / (float(np.sqrt((g * g).sum())) + 1e-9))
        k = memory["n"] = memory.get("n", 0) + 1
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        gru.flat -= RATE / (1 + k / 500) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-6)


def score(gru: Gru, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each whole document's classes."""
    classes, _, _, places = lanes(docs)
    each = np.zeros(classes.shape, np.float32)
    for t, active, target, _, _, _, _, _, logits in _windows(gru, docs, end):
        each[t:t + len(target), :active] = np.take_along_axis(logits, target.astype(np.int64)[:, None, :], 1)[:, 0]
    return np.array([each[at:at + len(d), lane].sum(dtype=np.float64) for d, (lane, at) in zip(docs, places)])
