"""Suffix automata of token sequences up to a bounded depth, on numpy arrays.

A state of a suffix automaton is a set of substrings that end at the same places, and its suffix link leads to the state of the longest of their suffixes that end at more.
The links form a tree, that of the contexts read backwards; it is made here level by level: contexts of d tokens are named by the name of their last d - 1
tokens and the token before. Contexts with as many ends as the one shorter by a token have the same ends, and share its state. Transitions aren't kept,
as enumerating substrings by their ends needs none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Automaton:
    """For each state: the length of its longest substring, its suffix link (-1: the root, of length 0), the number of places where its substrings end, and one of them."""

    length: np.ndarray
    link: np.ndarray
    count: np.ndarray
    end: np.ndarray

    def shortest(self) -> np.ndarray:
        """The length of each state's shortest substring: one more than the longest of its suffix link."""
        return np.where(self.link >= 0, self.length[self.link], 0) + 1

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """One end and the number of ends of every different substring of a length."""
        held = np.flatnonzero((self.length >= length) & (self.shortest() <= length))
        return self.end[held], self.count[held]


def build(tokens: np.ndarray, reach: np.ndarray, depth: int) -> Automaton:
    """The generalised automaton of all contexts: tokens are whole numbers from 0, and reach tells how many of the last tokens, itself among them, may be read at a place (0: none)."""
    alive = np.flatnonzero(reach >= 1)
    names, span = np.zeros(len(tokens), np.int64), int(tokens.max(initial=0)) + 1
    levels, total = [], 0
    for d in range(1, depth + 1):
        if not len(alive):
            break
        keys = names[alive] * span + tokens[alive - (d - 1)]
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(order), bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        end = alive[order[heads]]
        above = names[end] if d > 1 else np.full(len(heads), -1, np.int64)
        levels.append((above + (total - len(levels[-1][1]) if d > 1 else 0), np.diff(np.append(heads, len(order))), end, np.full(len(heads), d, np.int64)))
        names[alive[order]] = np.cumsum(new) - 1
        total += len(heads)
        alive = alive[reach[alive] > d]
    if not levels:
        none = np.zeros(0, np.int64)
        return Automaton(none, none, none, none)
    parent, count, end, length = (np.concatenate(x) for x in zip(*levels, strict=True))
    # a context whose parent ends at as many places is the only child of it that does, and takes it in
    joins = (length > 1) & (count == np.where(length > 1, count[parent], 0))
    longest = np.arange(len(parent))
    for d in range(depth, 1, -1):
        some = np.flatnonzero(joins & (length == d))
        longest[parent[some]] = longest[some]
    states = np.flatnonzero(longest == np.arange(len(parent)))
    number = np.full(len(parent), -1, np.int64)
    number[states] = np.arange(len(states))
    top = np.arange(len(parent))  # the shortest context that shares the state
    for d in range(2, depth + 1):
        some = np.flatnonzero(joins & (length == d))
        top[some] = top[parent[some]]
    above = parent[top[states]]
    link = np.where(length[top[states]] > 1, number[longest[above]], -1)
    return Automaton(length[states], link, count[states], end[states])
