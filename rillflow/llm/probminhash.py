"""ProbMinHash signatures of weighted shingles, and exact Jaccard similarity, over Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rillflow.llm.common import mixed, split_words, word_hashes

STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of each text's distinct shingles, ordered by text and hash.

    A text of fewer words than ``width`` has one shingle, of all its words; one without words has none.
    """
    codes, offsets, words = split_words(texts)
    n = np.diff(offsets)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(words)[codes]
    count = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    value = np.zeros(len(text), np.uint64)
    for k in range(width):
        at = first + k
        here = at < offsets[text + 1]
        value = np.where(here, value * STEP + mixed(h[np.minimum(at, len(h) - 1)]), value)
    value = mixed(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return value[at], text[at], np.diff(np.append(at, len(value)))


def signatures(value: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """ProbMinHash: n_texts x size shingle hashes; texts without shingles have zeros.

    Each shingle is a Poisson process at the rate of its weight; each arrival goes to a random component, which keeps the
    shingle that arrives first. A shingle stops once its time is past the latest of its text's components.
    """
    time = np.full(n_texts * size, np.inf)
    holder = np.zeros(n_texts * size, np.uint64)
    live = np.arange(len(value))
    clock = np.zeros(len(value))
    state = value.copy()
    while len(live):
        state = mixed(state + STEP)
        u = ((state >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53
        clock -= np.log(u) / weight[live]
        slot = text[live] * size + (mixed(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)
        sooner = np.flatnonzero(clock < time[slot])
        s, t = slot[sooner], clock[sooner]
        np.minimum.at(time, s, t)
        won = t == time[s]
        holder[s[won]] = value[live[sooner[won]]]
        stay = clock < time.reshape(n_texts, size).max(axis=1)[text[live]]
        live, clock, state = live[stay], clock[stay], state[stay]
    return holder.reshape(n_texts, size)


def jaccard(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of texts; 0 where neither has a shingle."""
    n = len(left)
    a, ta, _ = shingles(left, width)
    b, tb, _ = shingles(right, width)
    value, text = np.concatenate([a, b]), np.concatenate([ta, tb])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    same = (value[1:] == value[:-1]) & (text[1:] == text[:-1])
    both = np.bincount(text[1:][same], minlength=n)
    union = np.bincount(text, minlength=n) - both
    return np.divide(both, union, out=np.zeros(n), where=union > 0)
