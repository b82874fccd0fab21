"""SetSketch registers of sets of 64-bit hashes, and the joint likelihood of two sketches.

An element visits registers at the points of a Poisson process: the spacings are
exponential, each point falls on a register at random, so every register sees
independent exponential values. A register keeps the smallest value of all elements, as the
truncated logarithm K = 1 - log_B(value). Registers of a union are the larger of both.
"""

from __future__ import annotations

import numpy as np

from newsloom.llm.hashing import GOLDEN, mix

REGISTERS = 128
B = 1.001
A = 20.0
TOP = 65_535


def registers(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int = REGISTERS) -> np.ndarray:
    """Registers of ``n_sets`` non-empty sets; ``owner`` says which set an element belongs to.

    Points beyond a limit cannot matter once every register of the set has a value below it;
    sets where the limit was too small are done again with twice the limit.
    """
    sizes = np.bincount(owner, minlength=n_sets)
    limit = (np.log(m) + 3) / np.maximum(sizes, 1)
    least = np.full(n_sets * m, np.inf)
    todo = np.ones(n_sets, bool)
    while todo.any():
        chosen = todo[owner]
        h, of = elements[chosen], owner[chosen].astype(np.int64)
        x = np.zeros(len(h))
        step = np.uint64(0)
        while len(h):
            with np.errstate(over="ignore"):
                step = step + GOLDEN
                u = mix(h + step)
            x = x - np.log1p(-(u >> np.uint64(12)).astype(np.float64) * 2.0**-52) / m
            near = x <= limit[of]
            h, of, x, u = h[near], of[near], x[near], u[near]
            np.minimum.at(least, of * m + (u % np.uint64(m)).astype(np.int64), x)
        todo &= (least.reshape(n_sets, m) > limit[:, None]).any(axis=1)
        limit[todo] *= 2
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(least / A) / np.log(B))
    return np.clip(values, 0, TOP).astype(np.uint16).reshape(n_sets, m)


def jaccard(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The Jaccard similarity under which the order of the registers is most likely."""
    above = (left > right).sum(axis=1)[:, None]
    below = (left < right).sum(axis=1)[:, None]
    equal = left.shape[1] - above - below
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    likelihood = (
        above * np.log(up + tiny) + below * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))
    )
    return j[np.arange(len(j)), likelihood.argmax(axis=1)]
