"""Linear-chain conditional random field in numpy: three tags, hashed features, exact gradients, exact decoding.

A sequence starts after an outside token. The score of a path is the sum of the weights of each token's features under
its tag and of the moves between neighbouring tags.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3


@dataclass
class Chain:
    weight: np.ndarray   # (features, tags)
    move: np.ndarray     # (tag before, tag)

    def emissions(self, features) -> np.ndarray:
        """``features``: one array of feature numbers per template -> (tokens, tags)."""
        out = None
        for f in features:
            each = np.take(self.weight, f, 0)
            out = each if out is None else np.add(out, each, out)
        return out

    def slack(self) -> float:
        """What moves can gain at most by a token that is not outside, whatever its neighbours' tags are."""
        into = self.move[:, 1:] - self.move[:, :1]
        both = into[:, :, None] + self.move[None, 1:, :] - self.move[None, :1, :]
        return float(max(into.max(), both.max()))

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence (the lowest tag on ties)."""
        back = np.zeros(e.shape, np.int64)
        s = self.move[OUTSIDE] + e[0]
        for t in range(1, len(e)):
            every = s[:, None] + self.move
            back[t] = every.argmax(0)
            s = every.max(0) + e[t]
        out = np.zeros(len(e), np.int64)
        out[-1] = s.argmax()
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def tags(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of many sequences laid end to end; ``first`` marks the tokens that start one.

        A token whose outside score leads by more than ``slack`` is outside on every best path: changing it to outside
        would raise the score. Paths are searched only between such tokens, with the same result as over the whole."""
        out = np.zeros(len(e), np.int64)
        if not len(e):
            return out
        open_ = e[:, OUTSIDE] - e[:, 1:].max(1) <= self.slack()
        begins = np.flatnonzero(open_ & (first | ~np.append(False, open_[:-1])))
        ends = np.flatnonzero(open_ & np.append(first[1:] | ~open_[1:], True)) + 1
        for a, b in zip(begins.tolist(), ends.tolist()):
            part = e[a:b]
            if b < len(e) and not first[b]:
                part = part.copy()
                part[-1] += self.move[:, OUTSIDE]
            out[a:b] = self.decode(part)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gradients(chain: Chain, x: np.ndarray, y: np.ndarray, size: np.ndarray):
    """Features (sequences, places, templates), tags (sequences, places; those from ``size`` on count for nothing) ->
    log-likelihood and its gradients by emissions and moves."""
    n, places = y.shape
    e = chain.weight[x].sum(2)
    live = np.arange(places)[None, :] < size[:, None]
    alpha, beta = np.zeros((n, places, TAGS)), np.zeros((n, places, TAGS))
    alpha[:, 0] = chain.move[OUTSIDE] + e[:, 0]
    for t in range(1, places):
        step = _lse(alpha[:, t - 1, :, None] + chain.move, 1) + e[:, t]
        alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
    for t in range(places - 2, -1, -1):
        step = _lse(chain.move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], step, 0)
    total = _lse(alpha[:, -1], 1)
    hot = np.eye(TAGS)[y] * live[:, :, None]
    of_e = hot - np.exp(alpha + beta - total[:, None, None]) * live[:, :, None]
    pair = np.exp(alpha[:, :-1, :, None] + chain.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
    of_move = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1)) - pair.sum((0, 1))
    of_move[OUTSIDE] += of_e[:, 0].sum(0)
    before = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], 1)
    value = ((np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] + chain.move[before, y]) * live).sum() - total.sum()
    return value, of_e, of_move


def fit(x: np.ndarray, y: np.ndarray, size: np.ndarray, features: int, epochs: int = 12, batch: int = 512, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by steps scaled with past gradients, in an order that depends on the data alone."""
    chain = Chain(np.zeros((features, TAGS)), np.zeros((TAGS, TAGS)))
    seen_w, seen_m = np.full(chain.weight.shape, 1e-3), np.full(chain.move.shape, 1e-3)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        rows = order.permutation(len(y))
        for lo in range(0, len(rows), batch):
            at = rows[lo:lo + batch]
            _, of_e, of_move = gradients(chain, x[at], y[at], size[at])
            flat = x[at].reshape(-1)
            each = np.repeat(of_e.reshape(-1, TAGS), x.shape[2], 0)
            g = np.stack([np.bincount(flat, each[:, k], features) for k in range(TAGS)], 1) / len(at) - decay * chain.weight
            m = of_move / len(at) - decay * chain.move
            seen_w += g * g
            seen_m += m * m
            chain.weight += rate * g / np.sqrt(seen_w)
            chain.move += rate * m / np.sqrt(seen_m)
    return chain
