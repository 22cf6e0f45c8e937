"""Linear classifiers on hashed features, small enough to travel to every task."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def train(features: Sequence[np.ndarray], target: np.ndarray, width: int, *, weight: np.ndarray | None = None, seed: int = 7, epochs: int = 12, step: float = 0.3) -> np.ndarray:
    """Logistic regression with soft targets by mini-batches with a step size per weight; the last weight is the bias.

    target: one number a row, or one a row and label; the weights have the same shape behind the feature.
    Rows with equal features are put together first. weight: how much a row counts.
    """
    many = target.ndim == 2
    y = target if many else target[:, None]
    counts = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    groups: dict[bytes, int] = {}
    of = np.array([groups.setdefault(np.asarray(f, np.int32).tobytes(), len(groups)) for f in features], np.int64)
    rows = [np.frombuffer(k, np.int32) for k in groups]
    size = np.bincount(of, counts, len(rows))
    y = np.stack([np.bincount(of, counts * y[:, k], len(rows)) / np.maximum(size, 1e-12) for k in range(y.shape[1])], axis=1)
    share = np.sqrt(size)  # many equal rows count more, but not so much that they drown the rest
    w = np.zeros((width + 1, y.shape[1]))
    squares = np.full(w.shape, 1e-6)
    rng = np.random.default_rng(seed)
    rows = [r if len(r) else np.array([width], np.int32) for r in rows]  # a row without features has the bias
    length = np.array([len(r) for r in rows])
    batches = []  # what a batch looks at is found once, as batches stay the same and only their order changes
    for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
        if not len(batch):
            continue
        used, at = np.unique(np.concatenate([rows[r] for r in batch]), return_inverse=True)
        by_feature = np.argsort(at, kind="stable")
        row = np.repeat(np.arange(len(batch), dtype=np.int32), length[batch])
        begin = np.concatenate([[0], np.cumsum(length[batch])[:-1]])
        first = np.concatenate([[0], np.cumsum(np.bincount(at))[:-1]])
        batches.append((batch, used, at.astype(np.int32), begin, row[by_feature], first))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            batch, used, at, begin, row, first = batches[k]
            own = w[used]
            z = np.add.reduceat(own[at], begin, axis=0) + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) * (share[batch] / share[batch].sum())[:, None]
            grad = np.add.reduceat(g[row], first, axis=0) + 1e-5 * own  # only weights of this batch move
            squares[used] += grad**2
            w[used] -= step * grad / np.sqrt(squares[used])
            squares[-1] += g.sum(axis=0) ** 2
            w[-1] -= step * g.sum(axis=0) / np.sqrt(squares[-1])
    return w if many else w[:, 0]


def platt(scores: np.ndarray, target: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * score + b))) is how often rows of such a score are true; Newton steps on the logistic loss."""
    n_true, n = float(target.sum()), len(target)
    if not n_true or n_true == n:
        return 1.0, 0.0
    t = np.where(target > 0.5, (n_true + 1) / (n_true + 2), 1 / (n - n_true + 2))
    a, b = 1.0, 0.0
    x = np.clip(scores, -30, 30)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * x).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    return max(float(a), 1e-3), float(b)


def best_cut(p: np.ndarray, target: np.ndarray) -> float:
    """The probability above which flagging gives the best F1 on these rows; midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    s, t = p[order], target[order] > 0.5
    if not t.any():
        return float("inf")
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # a cut can't part equal scores
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


@dataclass
class Calibrated:
    """A linear classifier of several labels, and of whether there is any; with a calibration and a threshold for each."""

    labels: tuple[str, ...]
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    cut: np.ndarray

    def margins(self, features: Sequence[int]) -> np.ndarray:
        return self.weights[list(features)].sum(axis=0) + self.weights[-1]

    def decide(self, margins: np.ndarray) -> str | None:
        """The likeliest label, if it or that there is any is above its threshold."""
        p = 1 / (1 + np.exp(-np.clip(self.scale * margins + self.shift, -40, 40)))
        k = int(np.argmax(p[:-1]))
        return self.labels[k] if p[-1] >= self.cut[-1] or p[k] >= self.cut[k] else None


def fit_calibrated(rows: list[list[int]], kinds: list[str], families: list[str], labels: Sequence[str], width: int, folds: int = 3) -> Calibrated:
    """Weights from all rows; calibration and thresholds from rows of whole families that their weights haven't seen.

    rows: hashed features; kinds: the label of each, or '' for none; families: who wrote it. Each label's
    families, and those of the rows without, are dealt to the folds in turn.
    """
    features = [np.array(r, np.int32) for r in rows]
    target = np.array([[*(float(k == x) for x in labels), float(k != "")] for k in kinds])
    fold = np.zeros(len(rows), np.int64)
    for kind in ["", *labels]:
        own = [i for i, k in enumerate(kinds) if k == kind]
        turn = {f: n % folds for n, f in enumerate(sorted({families[i] for i in own}))}
        fold[own] = [turn[families[i]] for i in own]
    margins = np.zeros(target.shape)
    for k in range(folds):
        held = fold == k
        if held.any() and not held.all():
            w = train([f for f, h in zip(features, held) if not h], target[~held], width, epochs=5)
            for i in np.flatnonzero(held):
                margins[i] = w[features[i]].sum(axis=0) + w[-1]
    fits = [platt(margins[:, k], target[:, k]) for k in range(target.shape[1])]
    scale, shift = (np.array(x) for x in zip(*fits))
    likely = 1 / (1 + np.exp(-np.clip(scale * margins + shift, -40, 40)))
    cut = np.array([best_cut(likely[:, k], target[:, k]) for k in range(target.shape[1])])
    return Calibrated(tuple(labels), train(features, target, width, epochs=8), scale, shift, cut)
