"""Content-selected places in texts: where runs of words begin that two texts can be compared at."""

from __future__ import annotations

import numpy as np

from dataward.llm import arrays


def sliding_least(values: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value of every run of ``width`` neighbours of one row, rightmost among equals."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    place = np.arange(n)
    best, at, step = values.copy(), place.copy(), 1
    while step < width:
        hop = min(step, width - step)
        other, other_at = best[hop:], at[hop:]
        take = other <= best[:n - hop]
        best[:n - hop] = np.where(take, other, best[:n - hop])
        at[:n - hop] = np.where(take, other_at, at[:n - hop])
        step += hop
    whole = row[:n - width + 1] == row[width - 1:]
    return np.unique(at[:n - width + 1][whole])


def anchors(codes: np.ndarray, row: np.ndarray, length: int, width: int, gram: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of ``length``-word runs at minimiser places.

    Of every ``width`` neighbouring places the one whose ``gram`` words hash least is chosen, so each run of
    ``width + length - 1`` words that two texts share holds the same chosen place in both.
    """
    grams_at, grams = arrays.windows(codes, row, gram)
    chosen = grams_at[sliding_least(grams, row[grams_at], width)]
    at, hashes = arrays.windows(codes, row, length)
    chosen = chosen[np.isin(chosen, at, assume_unique=True)]
    return chosen, hashes[np.searchsorted(at, chosen)]
