"""A gated recurrent layer in numpy, forwards and by backpropagation through time.

Inputs come as (time, batch, 3 units) products with the input weights, so that a caller may look them up.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def run(inputs: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """States (time, batch, units); with ``keep`` also what ``backward`` needs."""
    steps, batch, width = inputs.shape
    units = width // 3
    states = np.zeros((steps + 1, batch, units), np.float32)
    saved = []
    gates_w, new_w = np.ascontiguousarray(recurrent[:, : 2 * units]), np.ascontiguousarray(recurrent[:, 2 * units :])
    for t in range(steps):
        h = states[t]
        gates = h @ gates_w
        gates += inputs[t, :, : 2 * units]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates += np.float32(1)
        gates *= np.float32(0.5)
        z, r = gates[:, :units], gates[:, units:]
        u = h @ new_w
        n = np.tanh(inputs[t, :, 2 * units :] + r * u)
        np.subtract(h, n, out=states[t + 1])
        states[t + 1] *= z
        states[t + 1] += n
        if keep:
            saved.append((z.copy(), r.copy(), u, n))
    return (states[1:], (states, saved, gates_w, new_w)) if keep else states[1:]


def backward(grad: np.ndarray, kept) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights from those of the states."""
    states, saved, gates_w, new_w = kept
    steps, batch, units = grad.shape
    d_inputs = np.empty((steps, batch, 3 * units), np.float32)
    d_gates, d_new = np.zeros_like(gates_w), np.zeros_like(new_w)
    later = np.zeros((batch, units), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, u, n = saved[t]
        h = states[t]
        d = grad[t] + later
        d_n = d * (1 - z) * (1 - n * n)
        d_u = d_n * r
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * u * r * (1 - r)
        both = np.concatenate([d_z, d_r], axis=1)
        d_inputs[t, :, : 2 * units] = both
        d_inputs[t, :, 2 * units :] = d_n
        d_gates += h.T @ both
        d_new += h.T @ d_u
        later = d * z + both @ gates_w.T + d_u @ new_w.T
    return d_inputs, np.concatenate([d_gates, d_new], axis=1)


class Adam:
    """Steps of Adam over a dict of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.n = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m, s = self.mean[k] / (1 - 0.9**self.n), self.square[k] / (1 - 0.999**self.n)
            self.weights[k] -= (self.rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * np.sqrt(2.0 / (shape[0] + shape[-1]))).astype(np.float32)
