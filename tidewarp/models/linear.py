"""Closed-form linear forecasters: naive, decomposition and last-value linear maps, autoregression, additive trend and seasons."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np

from .base import Forecaster, WindowForecaster


def ridge(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> np.ndarray:
    """Weights with an intercept row last; the intercept is not shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = strength * len(x) * np.eye(a.shape[1])
    penalty[-1, -1] = 0
    return np.linalg.lstsq(a.T @ a + penalty, a.T @ y, rcond=None)[0]


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Naive(WindowForecaster):
    name: ClassVar[str] = "naive"

    def fit_windows(self, x, y):
        return {"horizon": y.shape[1]}

    def predict_windows(self, state, x):
        return np.repeat(x[:, -1:], state["horizon"], axis=1)


@dataclass
class NLinear(WindowForecaster):
    """Subtract the last value, map linearly, add it back."""

    name: ClassVar[str] = "n_linear"
    strength: float = 1e-3

    def fit_windows(self, x, y):
        last = x[:, -1:]
        return {"w": ridge(x - last, y - last, self.strength)}

    def predict_windows(self, state, x):
        return apply(state["w"], x - x[:, -1:]) + x[:, -1:]


@dataclass
class DLinear(WindowForecaster):
    """Moving-average trend and remainder, a linear map for each."""

    name: ClassVar[str] = "d_linear"
    kernel_size: int = 25
    strength: float = 1e-3

    def _parts(self, x: np.ndarray) -> np.ndarray:
        k = min(self.kernel_size, 2 * x.shape[1] - 1)
        left, right = (k - 1) // 2, k // 2
        padded = np.concatenate([np.repeat(x[:, :1], left, 1), x, np.repeat(x[:, -1:], right, 1)], axis=1)
        trend = np.lib.stride_tricks.sliding_window_view(padded, k, axis=1).mean(axis=2)
        return np.concatenate([trend, x - trend], axis=1)

    def fit_windows(self, x, y):
        return {"w": ridge(self._parts(x), y, self.strength)}

    def predict_windows(self, state, x):
        return apply(state["w"], self._parts(x))


@dataclass
class AutoArima(Forecaster):
    """ARIMA(p, d, q) by Hannan-Rissanen: long autoregression for the shocks, then least squares; order by AIC, d by variance."""

    name: ClassVar[str] = "auto_arima"
    max_p: int = 8
    max_q: int = 2
    max_d: int = 1

    def fit_values(self, y, days):
        d = 0
        while d < self.max_d and len(y) > 10 and np.var(np.diff(y, d + 1)) < np.var(np.diff(y, d)):
            d += 1
        z = np.diff(y, d)
        best = None
        long = min(max(self.max_p + self.max_q, 1), max(1, len(z) // 4))
        shocks = np.zeros_like(z)
        x, t = self._design(z, shocks, long, 0)
        w = ridge(x, t, 1e-8)
        shocks[long:] = t - apply(w, x)
        for p in range(0, min(self.max_p, max(1, len(z) // 4)) + 1):
            for q in range(0, self.max_q + 1):
                x, t = self._design(z, shocks, p, q, start=long + self.max_q)
                if len(t) <= p + q + 2:
                    continue
                w = ridge(x, t, 1e-8)
                rss = float(np.sum((t - apply(w, x)) ** 2))
                aic = len(t) * np.log(max(rss, 1e-12) / len(t)) + 2 * (p + q + 1)
                if best is None or aic < best[0]:
                    best = (aic, p, q, w)
        if best is None:
            best = (0.0, 0, 0, np.array([z.mean() if len(z) else 0.0]))
        _, p, q, w = best
        keep = max(p, q, 1)
        return {"d": d, "p": p, "q": q, "w": w, "z": z[-keep:], "shocks": shocks[-keep:], "ends": np.array([np.diff(y, i)[-1] for i in range(d)])}

    @staticmethod
    def _design(z, shocks, p, q, start=None):
        first = max(p, q, start or 0)
        t = z[first:]
        columns = [z[first - i : len(z) - i] for i in range(1, p + 1)] + [shocks[first - i : len(z) - i] for i in range(1, q + 1)]
        return (np.column_stack(columns) if columns else np.zeros((len(t), 0))), t

    def predict_values(self, state, context, days):
        n, p, q = len(days), state["p"], state["q"]
        z, e = list(state["z"]), list(state["shocks"])
        out = []
        for _ in range(n):
            row = np.array([z[-i] for i in range(1, p + 1)] + [e[-i] for i in range(1, q + 1)])
            v = float(apply(state["w"], row[None, :])[0]) if len(row) else float(state["w"][-1])
            z.append(v)
            e.append(0.0)
            out.append(v)
        out = np.array(out)
        for end in reversed(state["ends"]):
            out = end + np.cumsum(out)
        return out


@dataclass
class Additive(Forecaster):
    """Piecewise-linear trend with daily (of times within days), weekly and yearly Fourier terms and optional holidays (days since 1970-01-01), by ridge.

    ``freq`` is the step of forecasts, if not the series' own; with ``include_history`` the fitted values come first.
    """

    name: ClassVar[str] = "prophet"
    changes: int = 10
    daily: int = 4
    weekly: int = 3
    yearly: int = 5
    strength: float = 1e-3
    holidays: tuple[int, ...] = ()
    freq: str | int | None = None
    include_history: bool = False

    def _design(self, days: np.ndarray, first: float, span: float, within: bool) -> np.ndarray:
        t = (days - first) / max(1, span)
        columns = [t]
        columns += [np.maximum(0, t - c) for c in np.linspace(0, 0.8, self.changes + 2)[1:-1]]
        for period, order in ((1.0, self.daily if within else 0), (7.0, self.weekly if span >= 14 else 0), (365.25, self.yearly if span >= 730 else 0)):
            for k in range(1, order + 1):
                columns += [np.sin(2 * np.pi * k * days / period), np.cos(2 * np.pi * k * days / period)]
        if self.holidays:
            columns.append(np.isin(np.floor(days), self.holidays).astype(float))
        return np.column_stack(columns)

    def fit_values(self, y, days):
        first, span, within = float(days[0]), float(days[-1] - days[0]), bool(len(np.unique(days % 1)) > 1)
        return {"first": first, "span": span, "within": within, "days": days, "w": ridge(self._design(days, first, span, within), y, self.strength)}

    def predict_values(self, state, context, days):
        return apply(state["w"], self._design(days, state["first"], state["span"], state["within"]))

    def fitted_values(self, state: dict) -> tuple[np.ndarray, np.ndarray]:
        return state["days"], self.predict_values(state, None, state["days"])
