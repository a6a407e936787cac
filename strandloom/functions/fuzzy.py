"""Fuzzy seeds: patterns with wildcards, insertions and deletions, and a greedy scan.

The scan makes no patterns. A state says how many symbols of the seed are used and how many defects were; the states that
a start can be in are bits of machine words, one row of words for each number of defects. Each symbol of the text moves
all starts of a block on at once: a symbol that fits or, for a defect, any symbol moves a bit up (a wildcard put for a
symbol); for a defect any symbol leaves it (a wildcard put in); for a defect a bit moves up without a symbol (one left out).
After `length` symbols a start matches if it has any bit left. Cost: text x length x defects, whatever the patterns' number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def patterns(seq: str, length: int, defects: int) -> list[str]:
    """All strings of `length` made from the first length + defects symbols of seq with at most so many wildcards put for a symbol, wildcards put in, or symbols left out. "." is the wildcard."""
    found: set[str] = set()

    def go(made: str, at: int, left: int) -> None:
        if len(made) == length:
            found.add(made)
            return
        if at < min(len(seq), length + defects):
            go(made + seq[at], at + 1, left)
            if left:
                go(made + ".", at + 1, left - 1)
                go(made, at + 1, left - 1)
        if left:
            go(made + ".", at, left - 1)

    go("", 0, defects)
    return sorted(found)


BLOCK = 1 << 15  # starts at a time


def up(x: np.ndarray) -> np.ndarray:
    """Bits of each column moved up by one over its words (first row lowest)."""
    out = x << np.uint64(1)
    out[1:] |= x[:-1] >> np.uint64(63)
    return out


def matches(text: np.ndarray, seq: str, length: int, defects: int) -> np.ndarray:
    """0-based starts, overlapping ones too, where a pattern of the seed matches the symbols (code points) of text."""
    code = np.frombuffer(seq.encode("utf-32-le"), np.uint32)[: length + defects]
    words = len(code) // 64 + 1
    known, which = np.unique(code, return_inverse=True)
    fits = np.zeros((words, len(known) + 1), np.uint64)  # the bit that a symbol at place i sets is i + 1; the last column is for symbols not in the seed
    for i, k in enumerate(which.tolist()):
        fits[(i + 1) // 64, k] |= np.uint64(1 << (i + 1) % 64)
    valid = np.zeros((words, 1), np.uint64)
    for i in range(len(code) + 1):
        valid[i // 64] |= np.uint64(1 << i % 64)
    found = []
    for a in range(0, len(text) - length + 1, BLOCK):
        part = text[a : a + BLOCK + length - 1]
        at = np.minimum(np.searchsorted(known, part), max(len(known) - 1, 0))
        symbol = np.where(known[at] == part, at, len(known)) if len(known) else np.zeros(len(part), np.int64)
        n = len(part) - length + 1
        state = [np.zeros((words, n), np.uint64) for _ in range(defects + 1)]
        state[0][0] = 1
        for e in range(1, defects + 1):
            state[e] = up(state[e - 1]) & valid
        for k in range(length):
            fit = fits[:, symbol[k : k + n]]
            new = [up(state[0]) & fit]
            for e in range(1, defects + 1):
                wild = up(state[e - 1]) | state[e - 1]
                new.append((up(state[e]) & fit | wild | up(new[e - 1])) & valid)
            state = new
        hit = np.zeros(n, bool)
        for x in state:
            hit |= x.any(axis=0)
        found.append(np.flatnonzero(hit) + a)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def apart(starts: np.ndarray, length: int) -> list[int]:
    """From the left, each `length` apart at least."""
    out, at = [], 0
    while at < len(starts):
        out.append(int(starts[at]))
        at = int(np.searchsorted(starts, out[-1] + max(length, 1)))
    return out


def fuzzy_starts(ref: Column, seq: str, length: int, defects: int) -> Column:
    """1-based starts of matches of `patterns`, from the left, each `length` symbols apart at least; none in a null text."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            # one text as code points at a time, and its starts as an array: a batch of either as objects is many times the texts
            found = (apart(matches(np.frombuffer((s or "").encode("utf-32-le"), np.uint32), seq, length, defects), length) for s in b)
            yield pd.Series([np.array(x, np.int32) + 1 for x in found], dtype=object)

    return run(ref)
