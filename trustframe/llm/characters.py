"""Kneser-Ney models of the letters of words, in sorted arrays of hashed codes."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
BITS = 6
#: Distinct words a task keeps at a time, for counting and for scores.
WORDS_HELD = 200_000
#: Words whose runs a task makes at a time.
WORDS_SCORED = 1 << 14


def letter_classes(text: str) -> np.ndarray:
    """Letters as 6-bit classes: 0 for a space, 1 to 26 for a to z, the other 37 shared by all other letters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    latin = (points >= 97) & (points <= 122)
    other = 27 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(37)
    return np.where(points == 32, 0, np.where(latin, points - 96, other)).astype(np.uint64)


def word_grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of ``order`` classes in each word, and the index of the word of each.

    A word is led by order - 1 boundaries and ended by one, so every letter and the end are predicted from what
    stands before them in the word.
    """
    gap = " " * (order - 1)
    classes = letter_classes(gap + gap.join(words) + gap)
    codes = np.zeros(len(classes) - order + 1, np.uint64)
    for k in range(order):
        codes = codes << np.uint64(BITS) | classes[k:len(codes) + k]
    sizes = np.array([len(word) + 1 for word in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    steps = sizes + order - 2
    return codes[np.repeat(np.cumsum(steps) - steps, sizes) + within], owner


class Order(NamedTuple):
    """One order of a model: sorted codes with what is seen of them, sorted contexts with their back-off."""

    codes: np.ndarray
    seen: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def kneser_ney(codes: np.ndarray, counts: np.ndarray, order: int) -> dict[int, Order]:
    """Interpolated Kneser-Ney from counts of sorted codes: each order from ``order`` down to one.

    Below the highest order a class is counted by the number of different contexts it follows.
    """
    orders = {}
    for n in range(order, 0, -1):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))
        contexts, first = np.unique(codes >> np.uint64(BITS), return_index=True)
        totals = np.add.reduceat(counts, first).astype(float) if len(first) else np.zeros(0)
        kinds = np.diff(np.append(first, len(codes)))
        seen = (counts - discount) / np.repeat(totals, kinds)
        orders[n] = Order(codes, seen.astype(np.float32), contexts, (discount * kinds / totals).astype(np.float32))
        codes, counts = np.unique(codes & np.uint64((1 << BITS * (n - 1)) - 1), return_counts=True)
    return orders


def probability(orders: dict[int, Order], codes: np.ndarray) -> np.ndarray:
    value = np.full(len(codes), 1 / (1 << BITS))
    for n, level in sorted(orders.items()):
        own = codes & np.uint64((1 << BITS * n) - 1)
        value = _lookup(level.codes, level.seen, own, 0.0) \
            + _lookup(level.contexts, level.weight, own >> np.uint64(BITS), 1.0) * value
    return value


class WordScores(dict):
    """Rows of a matrix of scores by word. Words unknown so far are scored together, a batch at a time."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], columns: int):
        super().__init__()
        self.score, self.new = score, []
        self.matrix = np.zeros((0, columns), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self.matrix) + len(self.new)
        self.new.append(word)
        return row

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self) > WORDS_HELD:
            self.clear()
            self.matrix = self.matrix[:0]
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new:
            parts = [self.score(self.new[at:at + WORDS_SCORED]) for at in range(0, len(self.new), WORDS_SCORED)]
            self.matrix = np.concatenate([self.matrix, *parts])
            self.new = []
        return found


def word_sums(values: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    return np.add.reduceat(values, np.searchsorted(owner, np.arange(words)), axis=0)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())
