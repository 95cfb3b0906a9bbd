"""Decoder numerics in numpy: attention, GRU, greedy steps with an n-gram ban. Weights are inputs; none are shipped."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gru(x: np.ndarray, h: np.ndarray, w_in: np.ndarray, w_hidden: np.ndarray, b_in: np.ndarray, b_hidden: np.ndarray) -> np.ndarray:
    """One step; the gates lie in order reset, update, candidate."""
    a, b = w_in @ x + b_in, w_hidden @ h + b_hidden
    n = len(h)
    reset, update = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
    fresh = np.tanh(a[2 * n :] + reset * b[2 * n :])
    return (1 - update) * fresh + update * h


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt(np.mean(x * x, axis=-1, keepdims=True) + eps) * weight


def swiglu(x: np.ndarray, gate: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    g = x @ gate.T
    return (g * sigmoid(g) * (x @ up.T)) @ down.T


def rope(x: np.ndarray, positions: np.ndarray, base: float = 10_000.0) -> np.ndarray:
    """Rotates halves of the last axis."""
    half = x.shape[-1] // 2
    angle = positions[:, None] / base ** (np.arange(half) / half)
    c, s = np.cos(angle), np.sin(angle)
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * c - b * s, b * c + a * s], axis=-1)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = True) -> np.ndarray:
    scores = q @ k.T / np.sqrt(q.shape[-1])
    if causal:
        late = np.arange(k.shape[0])[None, :] > np.arange(q.shape[0])[:, None] + (k.shape[0] - q.shape[0])
        scores = np.where(late, -np.inf, scores)
    return softmax(scores) @ v


def banned(tokens: list[int], n: int = 35, window: int = 128, allowed: frozenset[int] = frozenset()) -> set[int]:
    """Tokens that would repeat an n-gram of the trailing window."""
    recent = tokens[-window:]
    tail = recent[len(recent) - n + 1 :]
    return {recent[i + n - 1] for i in range(len(recent) - n + 1) if recent[i : i + n - 1] == tail} - allowed if len(recent) >= n else set()


def greedy(logits: np.ndarray, ban: set[int]) -> int:
    """The first of the largest finite logits that aren't banned."""
    usable = np.where(np.isfinite(logits), logits, -np.inf)
    usable[list(ban)] = -np.inf
    if not np.isfinite(usable).any():
        raise ValueError("generation_failed")
    return int(np.argmax(usable))
