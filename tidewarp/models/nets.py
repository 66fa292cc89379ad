"""Neural forecasters in numpy: a trainer and one class per architecture.

Sizes default small, since every series trains a net of its own; all are parameters. Windows are scaled by
the series' mean and deviation.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np

from .autodiff import Tensor, concat, stack, wrap
from .base import WindowForecaster

LOSSES = {
    "mae": lambda p, y: (p - y).abs().mean(),
    "mse": lambda p, y: ((p - y) ** 2.0).mean(),
    "rmse": lambda p, y: (((p - y) ** 2.0).mean() + 1e-12) ** 0.5,
    "wmape": lambda p, y: (p - y).abs().sum() / (wrap(y).abs().sum() + 1e-12),
    "huber": lambda p, y: ((((p - y) ** 2.0) + 1.0) ** 0.5 - 1.0).mean(),
}


class Params:
    """Named weights; drawn on first use in training, given in prediction."""

    def __init__(self, seed: int, values: dict[str, np.ndarray] | None = None):
        self.rng = np.random.default_rng(seed)
        self.values = values or {}
        self.used: dict[str, Tensor] = {}

    def __call__(self, name: str, *shape: int, scale: float | None = None) -> Tensor:
        if name not in self.values:
            scale = (1 / max(1, shape[0])) ** 0.5 if scale is None else scale
            self.values[name] = self.rng.normal(0, 1, shape) * scale
        if name not in self.used:
            self.used[name] = Tensor(self.values[name])
        return self.used[name]

    def dense(self, name: str, x: Tensor, width: int, weight_norm: bool = False) -> Tensor:
        w = self(f"{name}.w", x.shape[-1], width)
        if weight_norm:
            w = weight_normed(w, self(f"{name}.g", width, scale=0.0) + 1.0)
        return x @ w + self(f"{name}.b", width, scale=0.0)


def weight_normed(v: Tensor, g: Tensor) -> Tensor:
    """g * v / |v|, the norm being each output's."""
    return v * (g / (((v * v).sum(0, True) + 1e-12) ** 0.5))


def schedule(kind: str | None, epoch: int, rate: float) -> float:
    """CosineAnnealing (half period 5), CosineAnnealingWarmRestarts (5, doubling), or the plain rate."""
    if kind == "CosineAnnealing":
        return rate * (1 + np.cos(np.pi * epoch / 5)) / 2 + 1e-5
    if kind == "CosineAnnealingWarmRestarts":
        at, length = epoch, 5
        while at >= length:
            at, length = at - length, length * 2
        return rate * (1 + np.cos(np.pi * at / length)) / 2
    return rate


@dataclass
class NetForecaster(WindowForecaster):
    """Adam on unshuffled batches with a gradient clip, a schedule and early stopping that restores the best weights."""

    width: int = 16
    epochs: int = 60
    rate: float = 0.01
    patience: int = 15
    loss: str = "mae"
    clip: float = 10.0
    batch_size: int = 0
    lr_scheduler: str | None = "ReduceLROnPlateau"
    noise: float = 0.0

    def loss_of(self, p: Params, x: Tensor, y: np.ndarray) -> Tensor:
        return LOSSES[self.loss](self.net(p, x, y.shape[1]), y)

    def net(self, p: Params, x: Tensor, outputs: int) -> Tensor:
        """(batch, lags) to (batch, outputs)."""
        raise NotImplementedError

    def fit_windows(self, x, y):
        mean, std = float(x.mean()), float(x.std()) or 1.0
        x, y = (x - mean) / std, (y - mean) / std
        held = max(1, len(x) // 10) if len(x) > 10 else 0
        cut = len(x) - held
        params = Params(self.seed)
        self.net(params, Tensor(x[:1]), y.shape[1])
        m = {k: np.zeros_like(v) for k, v in params.values.items()}
        v2 = {k: np.zeros_like(v) for k, v in params.values.items()}
        size = self.batch_size or int(min(16 * len(x), 5096))
        best, kept, waited, rate, t = np.inf, dict(params.values), 0, self.rate, 0
        for epoch in range(self.epochs):
            now = schedule(self.lr_scheduler, epoch, rate)
            for start in range(0, cut, size):
                params.used = {}
                seen = x[start : min(cut, start + size)]
                seen = seen + self.noise * params.rng.normal(size=seen.shape) if self.noise else seen
                out = self.loss_of(params, Tensor(seen), y[start : min(cut, start + size)])
                out.backward()
                grads = {k: w.grad for k, w in params.used.items() if w.grad is not None}
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                t += 1
                for k, g in grads.items():
                    g = g * min(1.0, self.clip / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    params.values[k] = params.values[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)
            params.used = {}
            a, b = (x[cut:], y[cut:]) if held else (x, y)
            score = float(self.loss_of(params, Tensor(a), b).data)
            if score < best - 1e-6:
                best, kept, waited = score, dict(params.values), 0
            else:
                waited += 1
                if self.lr_scheduler == "ReduceLROnPlateau" and waited % 5 == 0:
                    rate *= 0.5
                if waited >= self.patience:
                    break
        return {"mean": mean, "std": std, "weights": kept, "outputs": y.shape[1]}

    def predict_windows(self, state, x):
        params = Params(self.seed, dict(state["weights"]))
        return self.net(params, Tensor((x - state["mean"]) / state["std"]), state["outputs"]).data * state["std"] + state["mean"]


def lstm(p: Params, name: str, x: Tensor, width: int, reverse: bool = False) -> list[Tensor]:
    """Hidden states of (batch, time, features)."""
    h, c, out = Tensor(np.zeros((x.shape[0], width))), Tensor(np.zeros((x.shape[0], width))), []
    steps = range(x.shape[1])
    for t in reversed(steps) if reverse else steps:
        z = p.dense(name, concat([x[:, t], h]), 4 * width)
        i, f, o, g = z[:, :width].sigmoid(), (z[:, width : 2 * width] + 1.0).sigmoid(), z[:, 2 * width : 3 * width].sigmoid(), z[:, 3 * width :].tanh()
        c = f * c + i * g
        h = o * c.tanh()
        out.append(h)
    return out[::-1] if reverse else out


def attention(p: Params, name: str, q: Tensor, kv: Tensor, width: int, heads: int = 2, causal: bool = False) -> Tensor:
    parts = []
    for h in range(heads):
        size = max(1, width // heads)
        a, b, v = p.dense(f"{name}.q{h}", q, size), p.dense(f"{name}.k{h}", kv, size), p.dense(f"{name}.v{h}", kv, size)
        s = (a @ b.swap()) * (size**-0.5)
        if causal:
            s = s + np.triu(np.full(s.shape[-2:], -1e9), 1)
        parts.append(s.softmax() @ v)
    return p.dense(f"{name}.o", concat(parts), width)


def positions(n: int, width: int) -> np.ndarray:
    at = np.arange(n)[:, None] / 10000 ** (2 * (np.arange(width)[None, :] // 2) / width)
    return np.where(np.arange(width) % 2, np.cos(at), np.sin(at))


def encoder(p: Params, name: str, x: Tensor, width: int) -> Tensor:
    x = (x + attention(p, f"{name}.a", x, x, width)).normed()
    return (x + p.dense(f"{name}.f2", p.dense(f"{name}.f1", x, 2 * width).relu(), width)).normed()


def gated(p: Params, name: str, x: Tensor, width: int) -> Tensor:
    """Gated residual network."""
    h = p.dense(f"{name}.2", p.dense(f"{name}.1", x, width).silu(), width)
    skip = x if x.shape[-1] == width else p.dense(f"{name}.s", x, width)
    return (skip + p.dense(f"{name}.g", h, width).sigmoid() * h).normed()


@dataclass
class NBeats(NetForecaster):
    """Stacks of dense blocks: each subtracts its backcast and adds its forecast; the first stack has a polynomial basis."""

    name: ClassVar[str] = "n_beats"
    blocks: int = 3
    degree: int = 2

    def net(self, p, x, outputs):
        total = None
        for i in range(self.blocks):
            h = p.dense(f"{i}.b", p.dense(f"{i}.a", x, self.width).relu(), self.width).relu()
            if i == 0:
                powers = np.stack([np.linspace(0, 1, outputs) ** d for d in range(self.degree + 1)])
                back = np.stack([np.linspace(0, 1, x.shape[1]) ** d for d in range(self.degree + 1)])
                fore, past = p.dense(f"{i}.t", h, self.degree + 1) @ powers, p.dense(f"{i}.u", h, self.degree + 1) @ back
            else:
                fore, past = p.dense(f"{i}.f", h, outputs), p.dense(f"{i}.p", h, x.shape[1])
            x = x - past
            total = fore if total is None else total + fore
        return total


@dataclass
class NHits(NetForecaster):
    """Blocks at several rates: average pooling in, interpolation out."""

    name: ClassVar[str] = "n_hits"
    pools: tuple[int, ...] = (4, 2, 1)

    def net(self, p, x, outputs):
        n, total = x.shape[1], None
        for i, k in enumerate(self.pools):
            groups = max(1, n // k)
            pool = np.zeros((n, groups))
            for j in range(n):
                pool[j, min(groups - 1, j * groups // n)] = 1
            h = p.dense(f"{i}.a", x @ (pool / pool.sum(0)), self.width).relu()
            knots = max(1, outputs // k)
            spread = np.stack([np.interp(np.linspace(0, knots - 1, outputs) if knots > 1 else np.zeros(outputs), np.arange(knots), np.eye(knots)[j]) for j in range(knots)])
            fore = p.dense(f"{i}.f", h, knots) @ spread
            x = x - p.dense(f"{i}.p", h, n)
            total = fore if total is None else total + fore
        return total


@dataclass
class TCN(NetForecaster):
    """Dilated causal convolutions with residuals, their weights normed if asked."""

    name: ClassVar[str] = "tcn"
    kernel: int = 3
    levels: int = 3
    weight_norm: bool = False

    def net(self, p, x, outputs):
        h = p.dense("in", x.reshape(*x.shape, 1), self.width)
        for i in range(self.levels):
            step = 2**i
            shifted = [h]
            for k in range(1, self.kernel):
                move = np.eye(h.shape[1], k=-k * step)
                shifted.append(Tensor(move) @ h)
            h = h + p.dense(f"{i}", concat(shifted), self.width, self.weight_norm).relu()
        return p.dense("out", h[:, -1], outputs)


@dataclass
class TFT(NetForecaster):
    """Variables weighed by a selection network, a recurrent layer, attention over its states, and an output for each quantile.

    The variables are the values, their changes and a relative index. Trained on the quantiles' loss, if loss
    is ``quantile``; forecasts are the middle quantile.
    """

    name: ClassVar[str] = "tft"
    heads: int = 2
    loss: str = "quantile"
    quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)

    def select(self, p: Params, variables: list[Tensor]) -> Tensor:
        """The variables' encodings, weighed at each step by all of them."""
        weights = gated(p, "s", concat(variables), len(variables)).softmax()
        parts = [gated(p, f"v{i}", v, self.width) * weights[:, :, i : i + 1] for i, v in enumerate(variables)]
        out = parts[0]
        for part in parts[1:]:
            out = out + part
        return out

    def net_quantiles(self, p: Params, x: Tensor, outputs: int) -> list[Tensor]:
        index = Tensor(np.broadcast_to(np.linspace(-1, 0, x.shape[1])[None, :, None], (*x.shape, 1)))
        changes = concat([x[:, :1] * 0.0, x[:, 1:] - x[:, :-1]]) if x.shape[1] > 1 else x * 0.0
        e = self.select(p, [x.reshape(*x.shape, 1), changes.reshape(*x.shape, 1), index])
        h = (stack(lstm(p, "l", e, self.width)) + e).normed()
        a = gated(p, "g", h + attention(p, "a", h, h, self.width, self.heads, causal=True), self.width)
        return [p.dense(f"out{i}", a[:, -1], outputs) for i in range(len(self.quantiles))]

    def net(self, p, x, outputs):
        return self.net_quantiles(p, x, outputs)[len(self.quantiles) // 2]

    def loss_of(self, p, x, y):
        if self.loss != "quantile":
            return super().loss_of(p, x, y)
        total = 0.0
        for q, out in zip(self.quantiles, self.net_quantiles(p, x, y.shape[1]), strict=True):
            off = wrap(y) - out
            total = (off * (q - 0.5) + off.abs() * 0.5).mean() + total
        return total

    def predict_quantiles(self, state: dict, x: np.ndarray) -> dict[float, np.ndarray]:
        """Direct outputs by quantile."""
        params = Params(self.seed, dict(state["weights"]))
        found = self.net_quantiles(params, Tensor((x - state["mean"]) / state["std"]), state["outputs"])
        return {q: out.data * state["std"] + state["mean"] for q, out in zip(self.quantiles, found, strict=True)}


@dataclass
class GAU(NetForecaster):
    """Gated attention units with squared-relu scores."""

    name: ClassVar[str] = "gau"
    level: int = 2

    def net(self, p, x, outputs):
        h = p.dense("in", x.reshape(*x.shape, 1), self.width) + positions(x.shape[1], self.width)
        for i in range(self.level):
            n = h.normed()
            u, v, z = (p.dense(f"{i}.{k}", n, self.width).silu() for k in "uvz")
            q, k = z * p(f"{i}.gq", self.width, scale=1.0), z * p(f"{i}.gk", self.width, scale=1.0)
            s = ((q @ k.swap()) * (1.0 / x.shape[1])).relu()
            h = h + p.dense(f"{i}.o", u * ((s * s) @ v), self.width)
        return p.dense("out", h.reshape(h.shape[0], h.shape[1] * h.shape[2]), outputs)


@dataclass
class StackingRNN(NetForecaster):
    """Recurrent blocks with residual connections."""

    name: ClassVar[str] = "stacking_rnn"
    blocks: int = 2

    def net(self, p, x, outputs):
        h = p.dense("in", x.reshape(*x.shape, 1), self.width)
        for i in range(self.blocks):
            h = h + stack(lstm(p, f"{i}", h, self.width))
        return p.dense("out", h[:, -1], outputs) + x[:, -1:]


@dataclass
class Time2Vec(NetForecaster):
    """A linear and sine embedding of each step, then a recurrent layer."""

    name: ClassVar[str] = "time2vec"

    def net(self, p, x, outputs):
        z = x.reshape(*x.shape, 1)
        e = concat([p.dense("lin", z, 1), p.dense("sin", z, self.width - 1).sin()])
        return p.dense("out", lstm(p, "l", e, self.width)[-1], outputs)


@dataclass
class Transformer(NetForecaster):
    """Encoder layers over the window; a decoder of self-attention among the outputs' queries, attention to the window and a dense layer."""

    name: ClassVar[str] = "transformer"
    layers: int = 2

    def net(self, p, x, outputs):
        h = p.dense("in", x.reshape(*x.shape, 1), self.width) + positions(x.shape[1], self.width)
        for i in range(self.layers):
            h = encoder(p, f"e{i}", h, self.width)
        q = p.dense("q", Tensor(np.broadcast_to(positions(outputs, self.width), (x.shape[0], outputs, self.width))), self.width)
        q = (q + attention(p, "s", q, q, self.width, causal=True)).normed()
        d = (q + attention(p, "c", q, h, self.width)).normed()
        d = (d + p.dense("d2", p.dense("d1", d, 2 * self.width).relu(), self.width)).normed()
        return p.dense("out", d, 1).reshape(x.shape[0], outputs)


@dataclass
class TiDE(NetForecaster):
    """Residual dense encoder and decoder with a linear skip from the window."""

    name: ClassVar[str] = "tide"

    def _block(self, p, name, x, width):
        return (p.dense(f"{name}.2", p.dense(f"{name}.1", x, self.width).relu(), width) + p.dense(f"{name}.s", x, width)).normed()

    def net(self, p, x, outputs):
        h = self._block(p, "d", self._block(p, "e", x, self.width), self.width)
        return p.dense("out", h, outputs) + p.dense("skip", x, outputs)


@dataclass
class PatchRNN(NetForecaster):
    """Overlapping patches through a two-way recurrent layer."""

    name: ClassVar[str] = "patch_rnn"
    kernel: int = 4

    def net(self, p, x, outputs):
        k = min(self.kernel, x.shape[1])
        patches = stack([x[:, i : i + k] for i in range(x.shape[1] - k + 1)])
        e = p.dense("in", patches, self.width)
        ahead, back = lstm(p, "f", e, self.width), lstm(p, "b", e, self.width, reverse=True)
        return p.dense("out", concat([ahead[-1], back[0]]), outputs)


@dataclass
class ITransformer(NetForecaster):
    """Inverted: each variate's whole window is a token, and attention is among variates; instance-normalised.

    The variates of one series are its values, their changes, their moving average and what it leaves. Not in the
    presets, as a net only.
    """

    name: ClassVar[str] = "itransformer"
    layers: int = 2
    kernel: int = 3

    def variates(self, x: Tensor) -> list[Tensor]:
        n = x.shape[1]
        near = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :]) <= self.kernel // 2
        trend = x @ Tensor(near / near.sum(0, keepdims=True))
        change = x @ Tensor(np.eye(n) - np.eye(n, k=1)) * np.append(0.0, np.ones(n - 1))
        return [x, change, trend, x - trend]

    def net(self, p, x, outputs):
        mean = x.mean(1, True)
        spread = (((x - mean) ** 2.0).mean(1, True) + 1e-5) ** 0.5
        h = p.dense("in", stack(self.variates((x - mean) / spread)), self.width)
        for i in range(self.layers):
            h = encoder(p, f"e{i}", h, self.width)
        return p.dense("out", h[:, 0], outputs) * spread + mean
