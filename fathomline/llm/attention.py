"""A causal self-attention model over subword ids, in numpy.

One layer attends from each place to the places before it in its window; the next
subword is predicted in two softmaxes: its class, then the subword among those of
its class.  Classes are runs of the order of frequency, narrow where subwords are
frequent, so a prediction costs far less than one softmax over the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places that a window attends to, those of them that are only context, and those it predicts.
CONTEXT, OVERLAP = 24, 4
NEW = CONTEXT - OVERLAP
#: Ids before a text's or chunk's first target: the context and the place that predicts it.
BEFORE = OVERLAP + 1
WIDTH, CLASSES = 8, 32
_SEEN = np.tril(np.ones((CONTEXT, CONTEXT), dtype=np.float32))[OVERLAP:]
_LARGE = 1 << 22  # cells of a softmax at a time


@dataclass(frozen=True)
class Vocabulary:
    """Places of ids in the order of frequency, their classes, and the first scores, which are the frequencies'."""

    place: np.ndarray
    cut: np.ndarray
    class_of: np.ndarray
    bias: np.ndarray
    class_bias: np.ndarray

    @property
    def size(self) -> int:
        """Subwords and the end of a text, whose id is the greatest."""
        return len(self.place)

    @property
    def start(self) -> int:
        """What stands before a text, as a place."""
        return self.size


def vocabulary(counts: np.ndarray, classes: int = CLASSES) -> Vocabulary:
    """counts: of each id in the training texts.  One is added to each, so every id can occur."""
    mass = counts.astype(np.float64) + 1
    order = np.argsort(-mass, kind="stable")
    place = np.empty(len(mass), dtype=np.int32)
    place[order] = np.arange(len(mass))
    mass = mass[order]
    root = np.cumsum(np.sqrt(mass))
    edges = np.searchsorted(root, root[-1] * np.arange(1, classes) / classes) + 1
    cut = np.unique(np.concatenate(([0], np.minimum(edges, len(mass)), [len(mass)])))
    class_of = np.repeat(np.arange(len(cut) - 1), np.diff(cut)).astype(np.int32)
    total = np.add.reduceat(mass, cut[:-1])
    return Vocabulary(place, cut, class_of, np.log(mass / total[class_of]).astype(np.float32), np.log(total / total.sum()).astype(np.float32))


class Weights:
    """All weights as rows of one matrix; the last column holds biases."""

    def __init__(self, rows: np.ndarray, known: Vocabulary):
        self.rows, at = rows, 0
        for name, n in self.parts(known):
            setattr(self, name, rows[at : at + n])
            setattr(self, f"{name}_at", at)
            at += n

    @staticmethod
    def parts(known: Vocabulary) -> list[tuple[str, int]]:
        return [("inner", known.size + 1), ("outer", known.size), ("classes", len(known.cut) - 1), ("places", CONTEXT), ("query", WIDTH), ("key", WIDTH), ("value", WIDTH)]

    def attend(self) -> np.ndarray:
        """(WIDTH, 3 * WIDTH): from an input to its query (scaled), key and value."""
        return np.hstack([self.query[:, :WIDTH] / np.float32(np.sqrt(WIDTH)), self.key[:, :WIDTH], self.value[:, :WIDTH]])

    @classmethod
    def initial(cls, known: Vocabulary, seed: int = 9) -> Weights:
        n = sum(n for _, n in cls.parts(known))
        out = cls((np.random.default_rng(seed).standard_normal((n, WIDTH + 1)) * 0.2).astype(np.float32), known)
        out.rows[:, WIDTH] = 0
        out.outer[:] = 0
        out.outer[:, WIDTH] = known.bias
        out.classes[:] = 0
        out.classes[:, WIDTH] = known.class_bias
        return out


def layout(places: list[np.ndarray], known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Texts, each ended, one after the other with BEFORE starts before each; and where each begins (with the end)."""
    sizes = np.array([len(x) + BEFORE for x in places], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.full(BEFORE, known.start, dtype=np.int32)
    return np.concatenate([y for x in places for y in (starts, x)]) if places else np.empty(0, np.int32), begins


def windows(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a layout: each window's owner, its first place, and how many of its targets are real."""
    targets = np.diff(begins) - BEFORE
    n = -(-targets // NEW)
    owner = np.repeat(np.arange(len(n)), n)
    step = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * NEW
    return owner, begins[owner] + step, np.minimum(targets[owner] - step, NEW)


def _take(flat: np.ndarray, first: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' inputs (n, CONTEXT), the real targets' places among all n * NEW, and those targets in turn."""
    last = len(flat) - 1
    inputs = flat[np.minimum(first[:, None] + np.arange(CONTEXT), last)]
    some = np.flatnonzero(np.arange(NEW) < real[:, None])
    return inputs, some, flat[first[some // NEW] + BEFORE + some % NEW]


def _exp(scores: np.ndarray, most: float, bound: float = np.inf) -> np.ndarray:
    """In place; scores are small by training, and bounded in any case, so no maximum is taken off.  Those that `bound` holds within `most` need no clipping."""
    if not bound <= most:
        np.clip(scores, -most, most, out=scores)
    return np.exp(scores, out=scores)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def _ones(n: int) -> np.ndarray:
    return np.ones(n, dtype=np.float32)


def _segments(sorted_classes: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.flatnonzero(np.diff(sorted_classes)) + 1
    lows = [0, *edges.tolist()]
    return [(int(sorted_classes[lo]), lo, hi) for lo, hi in zip(lows, [*edges.tolist(), len(sorted_classes)], strict=True)] if len(sorted_classes) else []


class Trainer:
    """Adagrad over batches of windows, on a copy of the weights; counts how often each row was used."""

    def __init__(self, weights: Weights, known: Vocabulary, rate: float = 0.2):
        self.w, self.known, self.rate = Weights(weights.rows.copy(), known), known, rate
        self.sums = np.full(self.w.rows.shape, 1e-8, dtype=np.float32)
        self.used = np.zeros(len(self.w.rows), dtype=np.float64)

    def _move(self, at: slice | np.ndarray, g: np.ndarray, used: float | np.ndarray) -> None:
        self.used[at] += used
        width = slice(0, g.shape[1])
        if isinstance(at, slice):
            s, r = self.sums[at, width], self.w.rows[at, width]
            s += g * g
            r -= self.rate * g / np.sqrt(s)
        else:
            s = self.sums[at, width] + g * g
            self.sums[at, width] = s
            self.w.rows[at, width] -= self.rate * g / np.sqrt(s)

    def step(self, flat: np.ndarray, first: np.ndarray, real: np.ndarray) -> None:
        w, known = self.w, self.known
        inputs, some, target = _take(flat, first, real)
        n, total = len(inputs), len(target)
        one = np.float32(1 / total)
        attend = w.attend()
        x = np.take(w.inner[:, :WIDTH], inputs.ravel(), axis=0).reshape(n, CONTEXT, WIDTH)
        x += w.places[:, :WIDTH]
        flat_x = x.reshape(-1, WIDTH)
        qkv = (flat_x @ attend).reshape(n, CONTEXT, 3 * WIDTH)
        q, k, v = qkv[:, OVERLAP:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        a = q @ k.transpose(0, 2, 1)
        _exp(a, 30)
        a *= _SEEN
        a *= 1 / a.sum(axis=-1, keepdims=True)
        h = a @ v
        h += x[:, OVERLAP:]
        # in the order of the targets' classes; the last column meets the biases
        own = known.class_of[target]
        order = np.argsort(own, kind="stable")
        own, target, some = own[order], target[order], some[order]
        hidden = np.ones((total, WIDTH + 1), dtype=np.float32)
        hidden[:, :WIDTH] = np.take(h.reshape(-1, WIDTH), some, axis=0)
        every = np.arange(total)
        p = _exp(hidden @ w.classes.T, 60)
        p *= (one / (p @ _ones(p.shape[1])))[:, None]
        p[every, own] -= one
        back = p @ w.classes[:, :WIDTH]
        moves = [(slice(w.classes_at, w.classes_at + len(w.classes)), p.T @ hidden, float(total))]
        inside = target - known.cut[own]
        for c, lo, hi in _segments(own):
            a0, a1 = int(known.cut[c]), int(known.cut[c + 1])
            if a1 - a0 == 1:
                continue
            outer, g = w.outer[a0:a1], 0.0
            for b in range(lo, hi, max(1, _LARGE // (a1 - a0))):
                e = min(hi, b + max(1, _LARGE // (a1 - a0)))
                p = _exp(hidden[b:e] @ outer.T, 60)
                p *= (one / (p @ _ones(a1 - a0)))[:, None]
                p[every[: e - b], inside[b:e]] -= one
                back[b:e] += p @ outer[:, :WIDTH]
                g = g + p.T @ hidden[b:e]
            moves.append((slice(w.outer_at + a0, w.outer_at + a1), g, float(hi - lo)))
        # attention
        dh = np.zeros((n, NEW, WIDTH), dtype=np.float32)
        dh.reshape(-1, WIDTH)[some] = back
        da = dh @ v.transpose(0, 2, 1)
        da -= np.einsum("nij,nij->ni", da, a)[..., None]
        da *= a
        back = np.empty((n, CONTEXT, 3 * WIDTH), dtype=np.float32)
        back[:, :OVERLAP, :WIDTH] = 0
        np.matmul(da, k, out=back[:, OVERLAP:, :WIDTH])
        np.matmul(da.transpose(0, 2, 1), q, out=back[..., WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dh, out=back[..., 2 * WIDTH :])
        back = back.reshape(-1, 3 * WIDTH)
        g = flat_x.T @ back
        g[:, :WIDTH] /= np.float32(np.sqrt(WIDTH))
        moves += [(slice(at, at + WIDTH), np.ascontiguousarray(g[:, i * WIDTH : (i + 1) * WIDTH]), float(total)) for i, at in enumerate((w.query_at, w.key_at, w.value_at))]
        dx = (back @ attend.T).reshape(n, CONTEXT, WIDTH)
        dx[:, OVERLAP:] += dh
        moves.append((slice(w.places_at, w.places_at + CONTEXT), dx.sum(axis=0), float(total)))
        seen = np.bincount(inputs.ravel(), minlength=known.size + 1)
        rows = np.flatnonzero(seen)
        near = np.empty(len(seen), dtype=np.int64)
        near[rows] = np.arange(0, len(rows) * WIDTH, WIDTH)
        cells = (near[inputs.ravel()][:, None] + np.arange(WIDTH)).ravel()
        moves.append((rows, np.bincount(cells, weights=dx.ravel(), minlength=len(rows) * WIDTH).reshape(-1, WIDTH).astype(np.float32), seen[rows].astype(np.float64)))
        for move in moves:
            self._move(*move)

    def run(self, flat: np.ndarray, begins: np.ndarray, batch: int = 384) -> None:
        """One pass over a layout's windows in turn."""
        _, first, real = windows(begins)
        for lo in range(0, len(first), batch):
            self.step(flat, first[lo : lo + batch], real[lo : lo + batch])


class Scorer:
    """log10 probabilities of whole texts; every subword once, in a window that holds what is before it."""

    def __init__(self, weights: Weights, known: Vocabulary):
        w, self.known, wide = weights, known, slice(0, WIDTH)
        attend = w.attend()
        # with one layer, queries, keys, values and the residual are a subword's part and a place's part;
        # a column of ones behind the values sums the weights in the same product
        e, p = w.inner[:, wide], w.places[:, wide]
        self.keys = [np.hstack([z @ attend[:, WIDTH:], np.full((len(z), 1), k, np.float32)]) for k, z in enumerate((e, p))]
        self.late = [np.hstack([z @ attend[:, wide], z]) for z in (e, p[OVERLAP:])]
        self.classes, self.outer = np.ascontiguousarray(w.classes.T), w.outer
        # each softmax's longest row and largest bias, with slack for rounding: they bound its scores
        self.far = [(1.001 * float(_lengths(z[:, wide]).max()), 1.001 * float(np.abs(z[:, WIDTH]).max())) for z in (w.classes, *np.split(w.outer, known.cut[1:-1]))]

    def _batch(self, flat: np.ndarray, first: np.ndarray, real: np.ndarray) -> np.ndarray:
        inputs, some, target = _take(flat, first, real)
        kv = np.take(self.keys[0], inputs, axis=0)
        kv += self.keys[1]
        qx = np.take(self.late[0], inputs[:, OVERLAP:], axis=0)
        qx += self.late[1]
        a = qx[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
        _exp(a, 30)
        a *= _SEEN
        h = a @ kv[..., WIDTH:]
        x = h[..., :WIDTH]
        x *= 1 / h[..., WIDTH:]
        x += qx[..., WIDTH:]
        own = self.known.class_of[target]
        order = np.argsort(own, kind="stable")
        own, target = own[order], target[order]
        hidden = np.ones((len(target), WIDTH + 1), dtype=np.float32)
        hidden[:, :WIDTH] = np.take(x.reshape(-1, WIDTH), some[order], axis=0)
        reach = float(_lengths(hidden[:, :WIDTH]).max(initial=0))
        bounds = [reach * z + bias for z, bias in self.far]
        found = self._log_softmax(hidden, self.classes, own, bounds[0])
        inside = target - self.known.cut[own]
        for c, lo, hi in _segments(own):
            a0, a1 = int(self.known.cut[c]), int(self.known.cut[c + 1])
            if a1 - a0 > 1:
                for b in range(lo, hi, max(1, _LARGE // (a1 - a0))):
                    e = min(hi, b + max(1, _LARGE // (a1 - a0)))
                    found[b:e] += self._log_softmax(hidden[b:e], self.outer[a0:a1].T, inside[b:e], bounds[c + 1])
        out = np.empty(len(found))
        out[order] = found
        return np.add.reduceat(out, np.cumsum(real) - real) / np.log(10)

    @staticmethod
    def _log_softmax(hidden: np.ndarray, weights: np.ndarray, own: np.ndarray, bound: float) -> np.ndarray:
        p = hidden @ weights
        hit = p[np.arange(len(own)), own].clip(-60, 60).astype(np.float64)
        return hit - np.log(_exp(p, 60, bound) @ _ones(p.shape[1]))

    def score(self, flat: np.ndarray, begins: np.ndarray, batch: int = 1024) -> np.ndarray:
        """For a layout, the log10 probability of each text and its end."""
        owner, first, real = windows(begins)
        found = [self._batch(flat, first[lo : lo + batch], real[lo : lo + batch]) for lo in range(0, len(first), batch)]
        return np.bincount(owner, weights=np.concatenate(found) if found else None, minlength=len(begins) - 1).astype(np.float64)
