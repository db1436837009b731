"""A linear-chain conditional random field in numpy, over batches of sequences.

Emissions are (batch, time, labels); `length` gives each sequence's own length.
"""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(em: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Label marginals, expected transition counts and expected first labels."""
    b, t, k = em.shape
    live = np.arange(t)[None, :] < length[:, None]
    alpha = np.empty_like(em)
    beta = np.zeros_like(em)
    alpha[:, 0] = start + em[:, 0]
    for i in range(1, t):
        step = _lse(alpha[:, i - 1, :, None] + trans, 1) + em[:, i]
        alpha[:, i] = np.where(live[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = _lse(trans + (em[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(live[:, i + 1, None], step, 0.0)
    z = _lse(alpha[:, -1], 1)
    marginal = np.exp(np.minimum(alpha + beta - z[:, None, None], 0.0)) * live[:, :, None]
    pair = np.zeros((k, k))
    for i in range(1, t):
        p = alpha[:, i - 1, :, None] + trans + (em[:, i] + beta[:, i])[:, None, :] - z[:, None, None]
        pair += (np.exp(np.minimum(p, 0.0)) * live[:, i, None, None]).sum(0)
    return marginal, pair, marginal[:, 0].sum(0)


def viterbi(em: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels; ties go to the lower label. Past a sequence's end: 0."""
    b, t, k = em.shape
    steps = np.ascontiguousarray(em.transpose(1, 2, 0))  # a row of memory for each label
    live = np.arange(t)[:, None] < length[None, :]
    whole = int(length.min(initial=t))
    back = np.zeros((t, k, b), np.int8)
    score = start[:, None] + steps[0]
    for i in range(1, t):
        best, at = score[0] + trans[0][:, None], back[i]
        for a in range(1, k):
            way = score[a] + trans[a][:, None]
            np.copyto(at, a, where=way > best)
            np.maximum(best, way, out=best)
        best += steps[i]
        if i < whole:
            score = best
        else:
            at[:, ~live[i]] = np.arange(k)[:, None]
            score = np.where(live[i], best, score)
    path = np.zeros((t, b), np.int8)
    path[-1] = score.argmax(0)
    row = np.arange(b)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, path[i], row]
    return np.where(live, path, 0).T


def padded(rows: list[np.ndarray], fill=0) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    out = np.full((len(rows), max(1, length.max(initial=0)), *(max(n) for n in zip(*(r.shape[1:] for r in rows), strict=True))), fill, rows[0].dtype)
    for i, r in enumerate(rows):
        out[(i, *map(slice, r.shape))] = r
    return out, length


class FeatureCrf:
    """A CRF whose emissions are sums of weights of a token's feature numbers.

    Feature 0 has no weight; it fills up tokens with fewer features. Steps in `never`
    (from, to) are ruled out in fitting and decoding alike."""

    def __init__(self, features: int, labels: int, never: list[tuple[int, int]] = ()):
        self.w = np.zeros((features, labels))
        self.trans = np.zeros((labels, labels))
        self.start = np.zeros(labels)
        self.never = list(never)
        for step in self.never:
            self.trans[step] = -1e4

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.w[ids].sum(-2)

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], *, epochs: int = 8, batch: int = 64, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> FeatureCrf:
        """AdaGrad on the conditional log-likelihood."""
        rng, k = np.random.default_rng(seed), len(self.start)
        held = [np.full(p.shape, 1e-6) for p in (self.w, self.trans, self.start)]
        for _ in range(epochs):
            order = rng.permutation(len(xs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                ids, length = padded([xs[i] for i in pick])
                y, _ = padded([ys[i] for i in pick])
                live = np.arange(ids.shape[1])[None, :] < length[:, None]
                marginal, pair, first = forward_backward(self.emissions(ids), length, self.trans, self.start)
                gap = np.eye(k)[y] * live[:, :, None] - marginal
                flat, wide = ids.reshape(-1), np.repeat(gap.reshape(-1, k), ids.shape[2], 0)
                gw = np.stack([np.bincount(flat, wide[:, j], len(self.w)) for j in range(k)], 1)
                gw[0] = 0.0
                gt = -pair
                np.add.at(gt, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1.0)
                for step in self.never:
                    gt[step] = len(pick) * l2 * self.trans[step]
                gs = np.bincount(y[:, 0], minlength=k) - first
                for p, g, h in zip((self.w, self.trans, self.start), (gw, gt, gs), held, strict=True):
                    g = g / len(pick) - l2 * p
                    h += g * g
                    p += rate * g / np.sqrt(h)
        self.w[0] = 0.0
        return self

    def decode(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        if not xs:
            return []
        ids, length = padded(xs)
        path = viterbi(self.emissions(ids), length, self.trans, self.start)
        return [path[i, :n] for i, n in enumerate(length)]
