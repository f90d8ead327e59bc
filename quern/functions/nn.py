"""Formulas of a model's arithmetic on small arrays: losses, norms, rotations, optimizer steps, quantisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SOFTCAP = 15.0
#: Coefficients of the five polar-decomposition iterations.
POLAR = [
    (8.156554524902461, -22.48329292557795, 15.878769915207462),
    (4.042929935166739, -2.808917465908714, 0.5000178451051316),
    (3.8916678022926607, -2.772484153217685, 0.5060648178503393),
    (3.285753657755655, -2.3681294933425376, 0.46449024233003106),
    (2.3465413258596377, -1.7097828382687081, 0.42323551169305323),
]


def softcapped(x: Column, cap: float = SOFTCAP) -> Column:
    return cap * F.tanh(x / cap)


def cross_entropy(logits: Column, target: Column) -> Column:
    """Nats of a target under an array of logits; null for an ignored target, -1."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return F.when(target >= 0, F.log(total) + most - F.get(logits, target))


def rms_norm(x: Column, eps: float = 1.1920929e-07) -> Column:
    """An array by its root mean square."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.transform(x, lambda v: v / F.sqrt(mean + eps))


def relu_squared(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v > 0, v * v).otherwise(F.lit(0.0)))


def rotated(x: np.ndarray, position: int, base: float = 100_000.0) -> np.ndarray:
    """A head's vector turned by its position: the halves are the two coordinates of each pair."""
    half = len(x) // 2
    angle = position / base ** (np.arange(half) * 2 / len(x))
    a, b = x[:half], x[half:]
    return np.concatenate([a * np.cos(angle) + b * np.sin(angle), b * np.cos(angle) - a * np.sin(angle)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def with_value_embedding(values: np.ndarray, embedding: np.ndarray, gates: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Values (position, head, channel) with a gated share, from 0 to ``most`` by a logit for each head, of the token's value embedding."""
    return values + most * _sigmoid(gates)[..., None] * embedding


def smeared(x: np.ndarray, gates: np.ndarray, strength: float) -> np.ndarray:
    """Embeddings (position, channel) with a gated share of the one before; the first stays. ``gates``: a logit for each position."""
    out = x.copy()
    out[1:] += strength * _sigmoid(gates[1:])[:, None] * x[:-1]
    return out


def trunk(first: np.ndarray, layers: list, residual: list[float], given: list[float], backout: float) -> np.ndarray:
    """The residual stream through layers, each of which sees it mixed with the first embedding; half-way's stream is taken off at the end."""
    x, middle = first, None
    for k, (layer, own, again) in enumerate(zip(layers, residual, given, strict=True)):
        x = layer(own * x + again * first)
        if k == len(layers) // 2:
            middle = x
    return x if middle is None else x - backout * middle


def initial_bound(width: int, scale: float = 1.0) -> float:
    """The bound of a uniform start with the deviation of ``width ** -0.5``, times a scale."""
    return scale * (3.0 / width) ** 0.5


def convertible(rows: Column, columns: Column, multiple: int = 16, least: int = 128) -> Column:
    """Whether a matrix is computed in eight bits: both sides a multiple, and none too short."""
    return (rows % multiple == 0) & (columns % multiple == 0) & (F.least(rows, columns) >= least)


def windowed_mask(length: int, window: int) -> np.ndarray:
    """Which earlier positions each position sees: itself and up to ``window`` before it, all if negative."""
    back = np.arange(length)[:, None] - np.arange(length)[None, :]
    return (back >= 0) & ((window < 0) | (back <= window))


def adamw(p: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, lr: float, betas: tuple[float, float], eps: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameter and both moments after one decoupled-decay Adam step."""
    b1, b2 = betas
    first, second = b1 * first + (1 - b1) * grad, b2 * second + (1 - b2) * grad**2
    scale = np.sqrt(second / (1 - b2**step)) + eps
    return p * (1 - lr * decay) - lr / (1 - b1**step) * first / scale, first, second


def orthogonal(g: np.ndarray, steps: int = 5) -> np.ndarray:
    """Nearest matrix with singular values of about one, by polynomial iterations on the smaller side."""
    x = g / (np.linalg.norm(g) * 1.01 + 1e-6)
    flip = x.shape[0] > x.shape[1]
    x = x.T if flip else x
    for a, b, c in POLAR[:steps]:
        gram = x @ x.T
        x = a * x + (b * gram + c * gram @ gram) @ x
    return x.T if flip else x


def nesterov(grad: np.ndarray, buffer: np.ndarray, momentum: float) -> tuple[np.ndarray, np.ndarray]:
    """The gradient looked ahead along its running mean, and that mean."""
    mean = buffer + (grad - buffer) * (1 - momentum)
    return grad + (mean - grad) * momentum, mean


def even_variance(update: np.ndarray, second: np.ndarray, beta2: float, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """An update whose rows (columns of a wide matrix) are divided by their running root mean squares, of the same norm as before, and those mean squares."""
    across = 1 if update.shape[0] >= update.shape[1] else 0
    now = np.mean(np.square(update), axis=across, keepdims=True)
    second = second + (now - second) * (1 - beta2)
    even = update / np.sqrt(np.clip(second, least, None))
    return even * (np.linalg.norm(update) / max(float(np.linalg.norm(even)), least)), second


def cautious(p: np.ndarray, update: np.ndarray, lr: float, decay: float) -> np.ndarray:
    """The parameter after an update, decayed only where that pulls the same way."""
    agree = np.multiply(update, p) >= 0
    return np.where(agree, p * (1 - lr * decay), p) - lr * update


def muon(p: np.ndarray, grad: np.ndarray, buffer: np.ndarray, second: np.ndarray, lr: float, momentum: float, beta2: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameter, momentum and mean squares after one step of orthogonalised momentum."""
    ahead, buffer = nesterov(grad, buffer, momentum)
    update, second = even_variance(orthogonal(ahead), second, beta2)
    return cautious(p, update, lr, decay), buffer, second


def quantised(x: np.ndarray, most: float = 448.0, mantissa: int = 3) -> tuple[np.ndarray, float]:
    """Values scaled so that the largest is ``most``, rounded to so many mantissa bits, and the scale to multiply back."""
    scale = most / max(float(np.abs(x).max()), 1e-12)
    y = np.clip(x * scale, -most, most)
    exponent = np.floor(np.log2(np.maximum(np.abs(y), 2.0**-6)))
    unit = 2.0 ** (exponent - mantissa)
    return np.round(y / unit) * unit, 1 / scale
