"""A small reverse-mode differentiation of numpy arrays, enough for the nets here."""

from __future__ import annotations

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes that were broadcast."""
    while grad.ndim > len(shape):
        grad = grad.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and grad.shape[i] != 1:
            grad = grad.sum(i, keepdims=True)
    return grad


class Tensor:
    __slots__ = ("data", "grad", "parents")

    def __init__(self, data, parents=()):
        self.data = np.asarray(data, np.float64)
        self.grad, self.parents = None, parents

    @property
    def shape(self):
        return self.data.shape

    def __add__(self, o):
        o = wrap(o)
        return Tensor(self.data + o.data, ((self, lambda g: _fit(g, self.shape)), (o, lambda g: _fit(g, o.shape))))

    def __mul__(self, o):
        o = wrap(o)
        return Tensor(self.data * o.data, ((self, lambda g: _fit(g * o.data, self.shape)), (o, lambda g: _fit(g * self.data, o.shape))))

    def __pow__(self, k: float):
        return Tensor(self.data**k, ((self, lambda g: g * k * self.data ** (k - 1)),))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + (-wrap(o))

    def __rsub__(self, o):
        return wrap(o) + (-self)

    def __truediv__(self, o):
        return self * wrap(o) ** -1.0

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, o):
        o = wrap(o)
        turn = lambda a: np.swapaxes(a, -1, -2)
        return Tensor(self.data @ o.data, ((self, lambda g: _fit(g @ turn(o.data), self.shape)), (o, lambda g: _fit(turn(self.data) @ g, o.shape))))

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, key, g)
            return out

        return Tensor(self.data[key], ((self, back),))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Tensor(self.data.sum(axis, keepdims=keepdims), ((self, back),))

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else self.data.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape):
        return Tensor(self.data.reshape(shape), ((self, lambda g: g.reshape(self.shape)),))

    def swap(self, a=-1, b=-2):
        return Tensor(np.swapaxes(self.data, a, b), ((self, lambda g: np.swapaxes(g, a, b)),))

    def map(self, value, slope):
        return Tensor(value, ((self, lambda g: g * slope),))

    def tanh(self):
        v = np.tanh(self.data)
        return self.map(v, 1 - v * v)

    def sigmoid(self):
        v = 1 / (1 + np.exp(-np.clip(self.data, -40, 40)))
        return self.map(v, v * (1 - v))

    def relu(self):
        return self.map(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def sin(self):
        return self.map(np.sin(self.data), np.cos(self.data))

    def abs(self):
        return self.map(np.abs(self.data), np.sign(self.data))

    def silu(self):
        return self * self.sigmoid()

    def softmax(self):
        e = np.exp(self.data - self.data.max(-1, keepdims=True))
        v = e / e.sum(-1, keepdims=True)
        return Tensor(v, ((self, lambda g: v * (g - (g * v).sum(-1, keepdims=True))),))

    def normed(self):
        """Zero mean and unit variance over the last axis."""
        d = self - self.mean(-1, True)
        return d * ((d * d).mean(-1, True) + 1e-5) ** -0.5

    def backward(self) -> None:
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            t, done = stack.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                stack.append((t, True))
                stack += [(p, False) for p, _ in t.parents]
        self.grad = np.ones_like(self.data)
        for t in reversed(order):
            for p, back in t.parents:
                g = back(t.grad)
                p.grad = g if p.grad is None else p.grad + g


def wrap(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def concat(parts: list[Tensor], axis: int = -1) -> Tensor:
    cuts = np.cumsum([p.shape[axis] for p in parts])[:-1]

    def piece(i):
        return lambda g: np.split(g, cuts, axis)[i]

    return Tensor(np.concatenate([p.data for p in parts], axis), tuple((p, piece(i)) for i, p in enumerate(parts)))


def stack(parts: list[Tensor], axis: int = 1) -> Tensor:
    def piece(i):
        return lambda g: np.take(g, i, axis)

    return Tensor(np.stack([p.data for p in parts], axis), tuple((p, piece(i)) for i, p in enumerate(parts)))
