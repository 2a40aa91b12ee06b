"""Mersenne Twister draws (MT19937) for many seeds at once, as the legacy generator of NumPy hands them out.

States are arrays with a column for each seed, so that seeding and twisting are a few array operations for a whole batch of rows.
"""

from __future__ import annotations

import math

import numpy as np

#: Words of a state, and how far ahead a word is mixed in.
WORDS, AHEAD = 624, 397
BACK = WORDS - AHEAD
#: Multiplier of the seeding, matrix of the twist and masks of the tempering (fixed values).
SEEDING, MATRIX = np.uint32(1812433253), np.uint32(0x9908B0DF)
UPPER, LOWER = np.uint32(0x80000000), np.uint32(0x7FFFFFFF)
TEMPER_B, TEMPER_C = np.uint32(0x9D2C5680), np.uint32(0xEFC60000)
#: Seeds whose states are held at once: 10 MB.
SEEDS = 4096
#: Pairs of uniforms beyond those needed that are drawn for normals at first.
SPARE = 12


def seeded(seeds: np.ndarray) -> np.ndarray:
    """First states, a column each; every word follows from the one before it."""
    out = np.empty((WORDS, len(seeds)), np.uint32)
    out[0] = seeds
    for i in range(1, WORDS):
        out[i] = (out[i - 1] ^ (out[i - 1] >> np.uint32(30))) * SEEDING + np.uint32(i)
    return out


def twisted(words: np.ndarray) -> np.ndarray:
    """The next states, in stretches of which each needs the one before."""
    out = np.empty_like(words)

    def mixed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        y = (high & UPPER) | (low & LOWER)
        return (y >> np.uint32(1)) ^ (y & np.uint32(1)) * MATRIX

    out[:BACK] = words[AHEAD:] ^ mixed(words[:BACK], words[1 : BACK + 1])
    for a in range(BACK, WORDS - 1, BACK):
        b = min(a + BACK, WORDS - 1)
        out[a:b] = out[a - BACK : b - BACK] ^ mixed(words[a:b], words[a + 1 : b + 1])
    out[-1] = out[AHEAD - 1] ^ mixed(words[-1], out[0])
    return out


def tempered(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(11))
    x = x ^ ((x << np.uint32(7)) & TEMPER_B)
    x = x ^ ((x << np.uint32(15)) & TEMPER_C)
    return x ^ (x >> np.uint32(18))


def outputs(seeds: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit outputs of each seed after its first ``start``, a row each."""
    out = np.empty((len(seeds), count), np.uint32)
    for at in range(0, len(seeds), SEEDS):
        some = slice(at, at + SEEDS)
        place = start[some, None] + np.arange(count)
        left = np.arange(len(place))
        state, turn = seeded(seeds[some]), 0
        while len(left):
            state = twisted(state)
            rows, columns = np.nonzero(place[left] // WORDS == turn)
            out[at + left[rows], columns] = tempered(state[place[left[rows], columns] % WORDS, rows])
            turn += 1
            more = place[left, -1] >= turn * WORDS
            left, state = left[more], state[:, more]
    return out


def uniforms(seeds: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` doubles in [0, 1) of 53 bits after ``offsets`` of them, a row for each seed."""
    words = outputs(seeds, 2 * offsets, 2 * count)
    return ((words[:, ::2] >> np.uint32(5)) * 67108864.0 + (words[:, 1::2] >> np.uint32(6))) / 9007199254740992.0


_log = np.frompyfunc(math.log, 1, 1)


def normals(seeds: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` standard normals after skipping ``offsets`` uniforms: the polar method, second of a pair first."""
    needed = -(-count // 2)
    out = np.empty((len(seeds), 2 * needed))
    left, spare = np.arange(len(seeds)), SPARE
    while len(left):
        u = 2.0 * uniforms(seeds[left], offsets[left], 2 * (needed + spare)) - 1.0
        x, y = u[:, ::2], u[:, 1::2]
        r = x * x + y * y
        inside = (r < 1.0) & (r != 0.0)
        place = np.cumsum(inside, axis=1) - 1
        done = place[:, -1] >= needed - 1
        i, j = np.nonzero(inside & (place < needed) & done[:, None])
        f = np.sqrt(-2.0 * _log(r[i, j]).astype(float) / r[i, j])
        out[left[i], 2 * place[i, j]] = f * y[i, j]
        out[left[i], 2 * place[i, j] + 1] = f * x[i, j]
        left, spare = left[~done], 4 * spare
    return out[:, :count]
