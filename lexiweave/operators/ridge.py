"""Ridge regression of pair similarities on a few features, for every layer at once, from sums that Spark takes in one pass."""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalties that are tried, and into how many parts training rows are cut for it.
ALPHAS = tuple(float(a) for a in np.logspace(-2, 6, 15))
FOLDS = 5
#: Feature sets, each with the base.
SETS = {"baseline": ("ft", "bert"), "cross_add": ("ft", "bert", "cross"), "cross_fc": ("ft", "bert", "cross", "fc"), "cross_fa": ("ft", "bert", "cross", "fa"), "full": ("ft", "bert", "cross", "fc", "fa")}


def fold_of(place: Column, n: Column, folds: int = FOLDS) -> Column:
    """Contiguous folds of the places 0 ... n - 1; the first n mod folds have one more."""
    base, more = F.floor(n / F.lit(folds)), n % F.lit(folds)
    return F.when(place < more * (base + 1), F.floor(place / (base + 1))).otherwise(more + F.floor((place - more * (base + 1)) / F.greatest(base, F.lit(1)))).cast("int")


def gram_sums(rows: DataFrame, by: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """by..., n, and the sums of all products of features, target and 1: one row per group, whatever the number of rows."""
    names = [*features, target]
    sums = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names], *sums)


class _Sums:
    """Sums of one group as a matrix over (1, features, target)."""

    def __init__(self, row, names: Sequence[str]) -> None:
        self.m = np.zeros((len(names) + 1,) * 2)
        self.m[0, 0] = row["n"]
        for i, a in enumerate(names):
            self.m[0, i + 1] = self.m[i + 1, 0] = row[a]
            for j in range(i, len(names)):
                self.m[i + 1, j + 1] = self.m[j + 1, i + 1] = row[f"{a}_x_{names[j]}"]


def _solve(m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights for the raw features and the intercept, from sums m: features are standardised by population deviation first."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0))
    scale[scale == 0] = 1.0
    a, b = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    w = np.linalg.solve(a + alpha * np.eye(len(b)), b) / scale
    return w, float(mean[-1] - w @ mean[:-1])


def _r2(m: np.ndarray, w: np.ndarray, c: float) -> float:
    """R squared of the fit on the rows summed in m; 0 where the target is constant."""
    v = np.concatenate([[-c], -w, [1.0]])
    sse = float(v @ m @ v)
    sst = float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])
    return 1 - sse / sst if sst > 1e-12 * max(1.0, m[-1, -1]) else 0.0


def _pick(m: np.ndarray, names: Sequence[str], use: Sequence[str]) -> np.ndarray:
    at = [0, *[list(names).index(u) + 1 for u in use], len(names) + 1]
    return m[np.ix_(at, at)]


def fit_groups(rows: DataFrame, by: Sequence[str], target: str = "y") -> list[dict]:
    """For each group: R squared on test and training rows of every feature set, and the gains over the first.

    rows: by..., split ('train' or 'test'), fold (of training rows), ft, bert, cross, fc, fa, target. The
    penalty is the one with the best mean R squared over the folds; the fit is then on all training
    rows. What reaches the driver are the sums per group and fold.
    """
    names = ["ft", "bert", "cross", "fc", "fa"]
    sums = gram_sums(rows, [*by, "split", "fold"], names, target).collect()
    groups: dict[tuple, dict] = {}
    for r in sums:
        g = groups.setdefault(tuple(r[c] for c in by), {"train": {}, "test": None})
        m = _Sums(r, [*names, target]).m
        if r["split"] == "train":
            g["train"][r["fold"]] = m
        else:
            g["test"] = m if g["test"] is None else g["test"] + m
    out = []
    for key, g in sorted(groups.items(), key=lambda kv: tuple(map(str, kv[0]))):
        if not g["train"] or g["test"] is None:
            continue
        row = dict(zip(by, key))
        every = sum(g["train"].values())
        for name, use in SETS.items():
            whole, test = _pick(every, names, use), _pick(g["test"], names, use)
            folds = [_pick(m, names, use) for _, m in sorted(g["train"].items())]
            scores = {a: np.mean([_r2(f, *_solve(whole - f, a)) for f in folds]) if len(folds) > 1 else 0.0 for a in ALPHAS}
            alpha = max(ALPHAS, key=lambda a: (scores[a], -a))
            w, c = _solve(whole, alpha)
            row |= {f"r2_{name}": _r2(test, w, c), f"r2_train_{name}": _r2(whole, w, c), f"alpha_{name}": alpha}
        row |= {"n_train": int(every[0, 0]), "n_test": int(g["test"][0, 0])}
        row |= {f"delta_{n}": row[f"r2_{n}"] - row["r2_baseline"] for n in SETS if n != "baseline"}
        out.append(row)
    return out
