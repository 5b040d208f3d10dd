"""A linear-chain conditional random field with two labels, in numpy.

Training maximises the regularised conditional log likelihood by Adam over
forward-backward gradients; decoding is Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Crf:
    """Label scores are x @ emit + bias; step[a, b] scores label b after label a."""

    emit: np.ndarray
    bias: np.ndarray
    step: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.emit + self.bias

    def decode(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label sequence of each chain scores[offsets[k]:offsets[k + 1]]; ties go to label 1."""
        out = np.zeros(len(scores), dtype=np.int8)
        (s00, s01), (s10, s11) = self.step.tolist()
        zero, one = scores[:, 0].tolist(), scores[:, 1].tolist()
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b, back = zero[lo], one[lo], []
            for t in range(lo + 1, hi):
                a0, a1, b0, b1 = a + s00, b + s10, a + s01, b + s11
                back.append((a1 >= a0, b1 >= b0))
                a, b = max(a0, a1) + zero[t], max(b0, b1) + one[t]
            label = int(b >= a)
            out[hi - 1] = label
            for t in range(hi - 2, lo - 1, -1):
                label = int(back[t - lo][label])
                out[t] = label
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(chains: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 0.1, penalty: float = 1e-3, steps: bool = True) -> Crf:
    """chains: features (length, d); labels: 0 or 1 (length); chains are padded to the longest.  Without `steps` each label stands alone."""
    n, d, longest = len(chains), chains[0].shape[1], max(len(c) for c in chains)
    x, y, real = np.zeros((n, longest, d)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (c, z) in enumerate(zip(chains, labels, strict=True)):
        x[k, : len(c)], y[k, : len(c)], real[k, : len(c)] = c, z, True
    hot = np.eye(2)[y] * real[:, :, None]
    size = d * 2 + 2 + 4
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    pairs = real[:, 1:]
    seen_step = np.einsum("nta,ntb->ab", hot[:, :-1] * pairs[:, :, None], hot[:, 1:])
    for i in range(1, rounds + 1):
        emit, bias, step = w[: 2 * d].reshape(d, 2), w[2 * d : 2 * d + 2], w[2 * d + 2 :].reshape(2, 2)
        s = x @ emit + bias
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = s[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], _log_sum(ahead[:, t - 1, :, None] + step, 1) + s[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], _log_sum(step + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
        total = _log_sum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        edge = np.exp(ahead[:, :-1, :, None] + step + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        gap = hot - p
        g = np.concatenate([np.einsum("ntd,nta->da", x, gap).ravel(), gap.sum((0, 1)), (seen_step - edge.sum((0, 1))).ravel() * steps]) / real.sum() - penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return Crf(w[: 2 * d].reshape(d, 2), w[2 * d : 2 * d + 2], w[2 * d + 2 :].reshape(2, 2))


def _whole(labels: np.ndarray, lean: np.ndarray, words: np.ndarray, good: bool, share: float) -> np.ndarray:
    """The labels, changed where they are least sure until the share of words in label 1 is on the document's side."""
    out, total = labels.copy(), words.sum()
    for k in np.argsort(-lean if good else lean, kind="stable"):
        reached = (out * words).sum() >= share * total
        if reached == good:
            break
        out[k] = good
    return out


def fit_latent(documents: list[np.ndarray], words: list[np.ndarray], good: list[bool], share: float, longest: int, rounds: int = 2) -> Crf:
    """A field whose line labels are hidden: of a document only the side of its share of words in label 1 is known.

    Lines start with their document's side and are scored alone; then labels and
    field take turns: each line gets the field's label, as far as its document's
    share stays on the known side.  documents: features by line; chains are cut
    to `longest` lines.
    """

    def chains(rows: list[np.ndarray]) -> list[np.ndarray]:
        return [r[lo : lo + longest] for r in rows for lo in range(0, len(r), longest)]

    labels = [np.full(len(x), int(g)) for x, g in zip(documents, good, strict=True)]
    field = fit(chains(documents), chains(labels), steps=False)
    for _ in range(rounds):
        for k, x in enumerate(documents):
            scores = field.scores(x)
            labels[k] = _whole(field.decode(scores, np.array([0, len(x)])).astype(int), scores[:, 1] - scores[:, 0], words[k], good[k], share)
        field = fit(chains(documents), chains(labels))
    return field
