"""Recursions of state models over batches of sequences, vectorised over sequences and states.

Arrays are (sequence, step, state); each sequence has its own length and its own parameters, steps past its end count for
nothing. Logarithms of zero are allowed.
"""

from __future__ import annotations

import numpy as np


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Diagonal Gaussian log densities of x (sequence, step, column) under mean and var (sequence, state, column)."""
    out = np.tile(-0.5 * np.log(2 * np.pi * var).sum(2)[:, None, :], (1, x.shape[1], 1))
    for j in range(x.shape[2]):
        out -= 0.5 * (x[:, :, None, j] - mean[:, None, :, j]) ** 2 / var[:, None, :, j]
    return out


#: Steps between two rescalings of a recursion: what is seen is scaled to 1 at most, so so many steps can't underflow.
_RESCALE = 8


def forward(dens: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities and the log likelihood of each sequence."""
    n, steps, _ = dens.shape
    top = dens.max(2)
    seen = np.maximum(np.exp(dens - top[:, :, None]), 1e-30)
    alpha, lost = np.empty_like(dens), np.zeros((n, steps))
    p = (start * seen[:, 0])[:, None]
    alpha[:, 0] = p[:, 0]
    for t in range(1, steps):
        p = np.matmul(p, move)
        p *= seen[:, t, None]
        if t % _RESCALE == 0:
            s = p.sum(2)
            p /= s[:, :, None]
            lost[:, t] = np.log(s[:, 0])
        alpha[:, t] = p[:, 0]
    total = alpha.sum(2)
    last = (np.arange(n), lengths - 1)
    live = np.arange(steps) < lengths[:, None]
    score = np.log(total[last]) + np.cumsum(lost, 1)[last] + np.where(live, top, 0.0).sum(1)
    return alpha / total[:, :, None], score


def expected(dens: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smoothed state probabilities (zero past the end), expected moves and the log likelihood of each sequence.

    Either recursion is kept to a scale of its own; each step's probabilities are divided by their sum at the end.
    """
    alpha, score = forward(dens, lengths, start, move)
    steps = dens.shape[1]
    seen = np.maximum(np.exp(dens - dens.max(2)[:, :, None]), 1e-30)
    back, ahead = np.swapaxes(move, 1, 2), np.ones_like(dens)  # ahead: what is seen from a step on, by its state
    ends = set((lengths - 1).tolist())
    v = np.ones_like(dens[:, :1])
    for t in range(steps - 1, 0, -1):
        if t in ends:
            v[lengths - 1 == t] = 1.0  # a sequence begins here, backwards
        ahead[:, t] = v[:, 0]
        v = np.matmul(v * seen[:, t, None], back)
        if t % _RESCALE == 0:
            v /= v.sum(2, keepdims=True)
    if 0 in ends:
        v[lengths == 1] = 1.0
    ahead[:, 0] = v[:, 0]
    live = np.arange(steps) < lengths[:, None]
    gamma = alpha * ahead
    gamma *= (live / gamma.sum(2))[:, :, None]
    nxt = seen[:, 1:] * ahead[:, 1:]
    both = np.matmul(alpha[:, :-1], move) * nxt
    weight = live[:, 1:] / both.sum(2)
    moves = move * np.matmul(np.swapaxes(alpha[:, :-1], 1, 2), nxt * weight[:, :, None])
    return gamma, moves, score


def stays(dens: np.ndarray, start: np.ndarray, move: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of best paths made of stays, with log start, move and duration (sequence, state, stay of 1..D steps).

    best[:, t] scores the best path over the first t steps by its last state, age is how long its last stay is, source
    the state before it. A row of the table depends on the steps before it only, so it is what a shorter sequence would
    have given. Of paths of equal score the one with the shortest last stay, then the lowest states, is taken.
    """
    n, steps, k = dens.shape
    longest = duration.shape[2]
    total = np.concatenate([np.zeros((n, 1, k)), np.cumsum(dens, 1)], 1)
    lasts = duration.transpose(0, 2, 1)  # (sequence, stay, state)
    best, age, source = np.full((n, steps + 1, k), -np.inf), np.zeros((n, steps + 1, k), np.int32), np.full((n, steps + 1, k), -1, np.int8)
    enter = np.full((n, steps + 1, k), -np.inf)  # best score of starting a stay there, less what was seen until then
    enter[:, 0] = start
    for t in range(1, steps + 1):
        m = min(longest, t)
        score = enter[:, t - m : t][:, ::-1] + lasts[:, :m]
        at = score.argmax(1)
        best[:, t] = np.take_along_axis(score, at[:, None], 1)[:, 0] + total[:, t]
        age[:, t] = at + 1
        step = best[:, t, :, None] + move
        source[:, t] = step.argmax(1)
        enter[:, t] = step.max(1) - total[:, t]
    return best, age, source


def path_of(best: np.ndarray, age: np.ndarray, source: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Stays (state, begin, end) of the best path over the first length steps of one sequence's table."""
    out, t = [], length
    s = int(best[t].argmax())
    while t > 0:
        begin = t - int(age[t, s])
        out.append((s, begin, t))
        t = begin
        if t:
            s = int(source[t, s])
    return out[::-1]


def runs_of(states: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (state, begin, end) of equal consecutive states."""
    edge = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]])) if len(states) else np.empty(0, int)
    return [(int(states[a]), int(a), int(b)) for a, b in zip(edge, np.append(edge[1:], len(states)))]
