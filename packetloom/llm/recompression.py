"""Recompression of word sequences.

A round names maximal runs of one symbol, or cuts the symbols in two classes
by a bit of their name and names every pair of a left symbol followed by a
right one. A name is a hash of what it stands for, so it is the same in every
task and no dictionary has to be exchanged. What a round does inside a piece
of text depends on that piece only, but for a run and one symbol at either
end. Taking these away round after round leaves the core of a window: its
symbols of the highest level, the same wherever the window's words occur.
"""

from __future__ import annotations

import numpy as np

from packetloom.llm.support import mix

_PAIR = np.uint64(0x9FB21C651E98DF25)
_RUN = np.uint64(0xC2B2AE3D27D4EB4F)
_CORE = np.uint64(0x165667B19E3779F9)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def _name(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    return mix((a * kind + b) * kind)


def window_cores(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` words, the names of their cores and where these lie.

    ``words`` holds the hashes of the words of several texts in a row, and
    ``starts`` the place of each text's first word. The result names, for
    every window that lies in one text, its first word, its core and the
    place and level of the core as one number.
    """
    count = len(words)
    if count < size:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    head = np.zeros(count + 1, bool)
    head[starts] = True
    head = head[:count]
    text = np.cumsum(head)
    window = np.nonzero(text[:count - size + 1] == text[size - 1:])[0]
    # Runs.
    new = head.copy()
    new[1:] |= words[1:] != words[:-1]
    run = np.cumsum(new) - 1
    place = np.nonzero(new)[0]
    length = np.diff(np.append(place, count))
    symbols = words[place]
    symbols = np.where(length > 1, _name(symbols, length.astype(np.uint64), _RUN), symbols)
    text = text[place]
    low, high = run[window] + 1, run[window + size - 1]  # without the first and the last run
    name = _name(words[window], words[window + size - 1], _CORE)  # of windows that have no core at all
    where = window << 5 | 31
    open_ = np.nonzero(low < high)[0]
    low, high = low[open_], high[open_]
    level = 0
    while len(open_):
        level += 1
        name[open_] = _name(symbols[low], symbols[high - 1] + (high - low).astype(np.uint64), np.uint64(int(_CORE) + level))
        where[open_] = place[low] << 5 | level
        right = (mix(symbols ^ np.uint64(int(_LEVEL) * level & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
        second = np.zeros(len(symbols), bool)
        second[1:] = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        low = low + right[low]
        high = high - ~right[high - 1]
        rest = np.nonzero(low < high)[0]
        open_, low, high = open_[rest], low[rest], high[rest]
        at = np.nonzero(~second)[0]
        paired = np.append(second, False)[at + 1]
        following = symbols[np.minimum(at + 1, len(symbols) - 1)]
        index = np.cumsum(~second) - 1
        low, high = index[low], index[high - 1] + 1
        symbols = np.where(paired, _name(symbols[at], following, _PAIR), symbols[at])
        place, text = place[at], text[at]
    return window, name, where
