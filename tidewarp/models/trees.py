"""Histogram trees: boosting by levels, by best leaf or with one split a level, and a random forest; numpy only."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_features
from ..series import SeriesSpec
from .base import WindowForecaster, sliding
from .linear import ridge

BINS = 32


def bin_edges(x: np.ndarray) -> np.ndarray:
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def _sums(codes: np.ndarray, rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums and counts per feature and bin."""
    f = codes.shape[1]
    flat = (codes[rows] + np.arange(f) * BINS).ravel()
    return np.bincount(flat, np.repeat(g[rows], f), f * BINS).reshape(f, BINS), np.bincount(flat, minlength=f * BINS).reshape(f, BINS).astype(float)


def _gains(sums: np.ndarray, counts: np.ndarray, penalty: float, least: int, allowed: np.ndarray | None) -> np.ndarray:
    left, n_left = sums.cumsum(1)[:, :-1], counts.cumsum(1)[:, :-1]
    total, n = sums.sum(1, keepdims=True), counts.sum(1, keepdims=True)
    score = lambda s, c: s * s / (c + penalty)
    gain = score(left, n_left) + score(total - left, n - n_left) - score(total, n)
    gain[(n_left < least) | (n - n_left < least)] = -np.inf
    if allowed is not None:
        gain[~allowed] = -np.inf
    return gain


def grow(codes: np.ndarray, g: np.ndarray, rows: np.ndarray, how: str, depth: int, leaves: int, penalty: float, least: int, allowed: np.ndarray | None = None) -> dict:
    """A tree on targets g over binned features: node arrays feature, bin, left, right, value, and the rows of each leaf."""
    feature, at, left, right, node_rows, level = [-1], [0], [-1], [-1], [rows], [0]

    def split(node: int, f: int, b: int) -> None:
        own = node_rows[node]
        goes = codes[own, f] <= b
        for side, part in ((left, own[goes]), (right, own[~goes])):
            side[node] = len(feature)
            feature.append(-1)
            at.append(0)
            left.append(-1)
            right.append(-1)
            node_rows.append(part)
            level.append(level[node] + 1)
        feature[node], at[node] = f, b

    def best(node: int) -> tuple[float, int, int]:
        if len(node_rows[node]) < 2 * least or level[node] >= depth:
            return (-np.inf, 0, 0)
        gain = _gains(*_sums(codes, node_rows[node], g), penalty, least, allowed)
        k = int(gain.argmax())
        return (float(gain.flat[k]), k // (BINS - 1), k % (BINS - 1))

    if how == "oblivious":
        for _ in range(depth):
            now = [i for i in range(len(feature)) if feature[i] < 0]
            gain = sum(np.maximum(_gains(*_sums(codes, node_rows[i], g), penalty, 1, allowed), 0) for i in now if len(node_rows[i]) > 1)
            if not np.ndim(gain) or gain.max() <= 1e-12:
                break
            f, b = divmod(int(gain.argmax()), BINS - 1)
            for i in now:
                split(i, f, b)
    elif how == "leaf":
        open_ = {0: best(0)}
        while open_ and len(open_) < leaves:
            node = max(open_, key=lambda i: open_[i][0])
            gain, f, b = open_.pop(node)
            if gain <= 1e-12:
                break
            split(node, f, b)
            open_[left[node]], open_[right[node]] = best(left[node]), best(right[node])
    else:
        queue = [0]
        while queue:
            node = queue.pop(0)
            gain, f, b = best(node)
            if gain > 1e-12:
                split(node, f, b)
                queue += [left[node], right[node]]
    value = np.array([g[r].sum() / (len(r) + penalty) if len(r) else 0.0 for r in node_rows])
    return {"feature": np.array(feature), "bin": np.array(at), "left": np.array(left), "right": np.array(right), "value": value, "rows": node_rows}


def leaf_of(tree: dict, codes: np.ndarray) -> np.ndarray:
    node = np.zeros(len(codes), np.int64)
    while True:
        f = tree["feature"][node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        goes = codes[inner, f[inner]] <= tree["bin"][node[inner]]
        node[inner] = np.where(goes, tree["left"][node[inner]], tree["right"][node[inner]])


@dataclass
class Boosting:
    """Squared-error boosting of one output."""

    how: str = "level"
    rounds: int = 50
    rate: float = 0.1
    depth: int = 4
    leaves: int = 15
    penalty: float = 1.0
    least: int = 5
    linear: bool = False

    def fit(self, x: np.ndarray, y: np.ndarray) -> dict:
        edges = bin_edges(x)
        codes, rows = binned(x, edges), np.arange(len(x))
        base, trees = float(y.mean()), []
        f = np.full(len(y), base)
        for _ in range(self.rounds):
            tree = grow(codes, y - f, rows, self.how, self.depth, self.leaves, self.penalty, min(self.least, max(1, len(x) // 4)))
            own = tree.pop("rows")
            if self.linear:
                self._lines(tree, x, y - f, own)
            f = f + self.rate * self._value(tree, x, codes)
            trees.append(tree)
        return {"base": base, "edges": edges, "trees": trees}

    def _lines(self, tree: dict, x: np.ndarray, g: np.ndarray, own: list[np.ndarray]) -> None:
        """A ridge line in each leaf over the features that lead to it."""
        used = sorted({int(f) for f in tree["feature"] if f >= 0})
        tree["used"] = np.array(used, np.int64)
        lines = np.zeros((len(own), len(used) + 1))
        lines[:, -1] = tree["value"]
        for i, rows in enumerate(own):
            if tree["feature"][i] < 0 and used and len(rows) > 2 * len(used) + 2:
                lines[i] = ridge(x[rows][:, used], g[rows], 0.1)
        tree["lines"] = lines

    def _value(self, tree: dict, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        leaf = leaf_of(tree, codes)
        if "lines" in tree:
            w = tree["lines"][leaf]
            return (x[:, tree["used"].astype(np.int64)] * w[:, :-1]).sum(1) + w[:, -1]
        return tree["value"][leaf]

    def predict(self, state: dict, x: np.ndarray) -> np.ndarray:
        codes = binned(x, state["edges"])
        return state["base"] + self.rate * sum((self._value(t, x, codes) for t in state["trees"]), np.zeros(len(x)))


@dataclass
class Forest:
    rounds: int = 50
    depth: int = 8
    share: float = 0.6
    least: int = 3
    seed: int = 0

    def fit(self, x: np.ndarray, y: np.ndarray) -> dict:
        rng, edges = np.random.default_rng(self.seed), bin_edges(x)
        codes, trees = binned(x, edges), []
        for _ in range(self.rounds):
            allowed = rng.random(x.shape[1]) < self.share
            allowed[rng.integers(x.shape[1])] = True
            tree = grow(codes, y, rng.integers(0, len(x), len(x)), "level", self.depth, 0, 1e-9, self.least, allowed)
            tree.pop("rows")
            trees.append(tree)
        return {"edges": edges, "trees": trees}

    def predict(self, state: dict, x: np.ndarray) -> np.ndarray:
        codes = binned(x, state["edges"])
        return np.mean([t["value"][leaf_of(t, codes)] for t in state["trees"]], axis=0)


# --- strategies over any single-output regressor ----------------------------------------------------------


def fit_direct(make, x: np.ndarray, y: np.ndarray) -> dict:
    """One regressor per output."""
    return {"models": [make().fit(x, y[:, h]) for h in range(y.shape[1])]}


def predict_direct(make, state: dict, x: np.ndarray) -> np.ndarray:
    return np.column_stack([make().predict(m, x) for m in state["models"]])


def fit_chain(make, x: np.ndarray, y: np.ndarray) -> dict:
    """Output h also sees outputs before it (true ones in training)."""
    return {"models": [make().fit(np.column_stack([x, y[:, :h]]), y[:, h]) for h in range(y.shape[1])]}


def predict_chain(make, state: dict, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 0))
    for m in state["models"]:
        out = np.column_stack([out, make().predict(m, np.column_stack([x, out]))])
    return out


def fit_recursive(make, x: np.ndarray, y: np.ndarray) -> dict:
    """The first output only."""
    return {"model": make().fit(x, y[:, 0]), "steps": y.shape[1]}


@dataclass
class TreeForecaster(WindowForecaster):
    rounds: int = 50
    strategy: ClassVar[str] = "direct"
    differences: ClassVar[int] = 0

    def make(self):
        raise NotImplementedError

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.diff(x, self.differences, axis=1) if self.differences and x.shape[1] > self.differences else x

    def fit_windows(self, x, y):
        # Outputs are taken from the window's last value, so trees can follow a level they haven't seen.
        z, last = self.features(x), x[:, -1:]
        fit = {"direct": fit_direct, "chain": fit_chain, "recursive": fit_recursive}[self.strategy]
        return fit(self.make, z, y - last)

    def predict_windows(self, state, x):
        if self.strategy == "recursive":
            out = np.zeros((len(x), 0))
            for _ in range(state["steps"]):
                step = x[:, -1] + self.make().predict(state["model"], self.features(x))
                out = np.column_stack([out, step])
                x = np.column_stack([x[:, 1:], step])
            return out
        predict = predict_chain if self.strategy == "chain" else predict_direct
        return predict(self.make, state, self.features(x)) + x[:, -1:]


@dataclass
class CatBoost(TreeForecaster):
    """Oblivious trees."""

    name: ClassVar[str] = "catboost"

    def make(self):
        return Boosting("oblivious", self.rounds)


@dataclass
class LightGBM(TreeForecaster):
    """Leaf-wise trees with a line in each leaf."""

    name: ClassVar[str] = "lightgbm"

    def make(self):
        return Boosting("leaf", self.rounds, linear=True)


@dataclass
class XGBoost(TreeForecaster):
    """Trees by level."""

    name: ClassVar[str] = "xgboost"

    def make(self):
        return Boosting("level", self.rounds)


@dataclass
class RandomForest(TreeForecaster):
    name: ClassVar[str] = "random_forest"

    def make(self):
        return Forest(self.rounds, seed=self.seed)


@dataclass
class MultiOutput(LightGBM):
    name: ClassVar[str] = "multi_output_model"
    differences: ClassVar[int] = 1


@dataclass
class MultiStep(LightGBM):
    name: ClassVar[str] = "multi_step_model"
    strategy: ClassVar[str] = "recursive"
    differences: ClassVar[int] = 1


@dataclass
class Chain(LightGBM):
    name: ClassVar[str] = "regressor_chain"
    strategy: ClassVar[str] = "chain"
    differences: ClassVar[int] = 1


def peak_tops(x: np.ndarray) -> np.ndarray:
    """Places of interior maxima; a plateau with lower neighbours on both sides lies at its middle."""
    edges = np.append(0, np.flatnonzero(np.diff(x)) + 1)
    ends = np.append(edges[1:], len(x)) - 1
    v = x[edges]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (edges[top] + ends[top]) // 2


def far_peaks(x: np.ndarray, distance: int = 150) -> int:
    kept: list[int] = []
    for i in sorted(peak_tops(x).tolist(), key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return len(kept)


def statistics(x: np.ndarray) -> np.ndarray:
    """The statistics of functions.arrays.window_statistics and the two correlation blocks of each row, nan where they are null."""
    d = np.diff(x, axis=1)
    p25, p50, p75, p90 = (q[:, None] for q in np.quantile(x, [0.25, 0.5, 0.75, 0.9], axis=1))
    total = x.sum(1, keepdims=True)
    good = (x.min(1) >= 0) & (total[:, 0] > 0)
    share = np.where(good[:, None], x, 1) / np.where(good[:, None], total, 1)
    entropy = np.where(good, -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(1), np.nan)
    none = np.full(len(x), np.nan)
    of_d = [d.mean(1), np.abs(d).mean(1), np.median(d, 1), np.median(np.abs(d), 1)] if d.shape[1] else [none] * 4
    columns = [x.mean(1), p50[:, 0], x.max(1), x.min(1), p25[:, 0], p75[:, 0], x.std(1), entropy, *of_d]
    columns += [(x < p75).sum(1), (x < p25).sum(1), (x < p90).sum(1), (x > p90).sum(1), [len(peak_tops(r)) for r in x], [far_peaks(r) for r in x]]
    auto = [np.correlate(r, r, "same") for r in x]
    cross = [np.correlate(r, e, "same") for r, e in zip(x, d, strict=True)] if d.shape[1] else np.full_like(x, np.nan)
    return np.column_stack([*columns, np.array(auto), np.array(cross)]).astype(float)


@dataclass
class WideGBRT(LightGBM):
    """A chain over differenced and smoothed lags, the window statistics, and the 82 calendar features and the spec's features of the window's last row."""

    name: ClassVar[str] = "wide_gbrt"
    strategy: ClassVar[str] = "chain"
    wide_inputs: ClassVar[bool] = True
    difference: int = 1
    smoothing: int = 2
    extend_daily_target_features: bool = True

    def make(self):
        return Boosting("leaf", self.rounds)

    def inputs(self, df: DataFrame, spec: SeriesSpec, first: Column) -> Column:
        columns = [*calendar_features(F.col(spec.time), first).values(), *(F.col(c) for c in spec.features)]
        return F.array(*[c.cast("double") for c in columns])

    def wide(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """One row of inputs for each window x and the inputs of its last row."""
        lags = np.diff(x, self.difference, axis=1) if self.difference else x
        if 1 < self.smoothing <= lags.shape[1]:
            lags = np.lib.stride_tricks.sliding_window_view(lags, self.smoothing, axis=1).mean(axis=2)
        parts = [lags, statistics(x), own] if self.extend_daily_target_features else [lags, own]
        return np.nan_to_num(np.column_stack(parts))  # unknown statistics and features are 0

    def fit_wide(self, y: np.ndarray, own: np.ndarray) -> dict:
        x, z = sliding(y, self.lags, self.horizon(len(y)))
        return fit_chain(self.make, self.wide(x, own[self.lags - 1 :][: len(x)]), z - x[:, -1:])

    def predict_wide(self, state: dict, context: np.ndarray, own: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """All outputs; beyond them the inputs are rebuilt from the values so far and the first output is added."""
        values, n = context[-self.lags :].astype(float).tolist(), len(ahead)
        outputs = lambda row: values[-1] + predict_chain(self.make, state, self.wide(np.array([values[-self.lags :]]), row[None, :]))[0]
        values += outputs(own).tolist()
        while len(values) < self.lags + n:
            values.append(float(outputs(ahead[len(values) - self.lags - 1])[0]))
        return np.array(values[self.lags :][:n])
