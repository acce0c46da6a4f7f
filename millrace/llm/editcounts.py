"""Operator 7: edit-aware token counts by segment trees over pre-tokens.

A document is a row of leaves: stretches of whole pre-tokens that begin where no match of the pattern reaches across (white space
after something else). A segment tree over the leaves holds characters and tokens of every subtree. An edit goes down the
tree to the leaves it touches and changes their text; leaves whose border can be crossed after the edit join their neighbour
(the boundary context); then the changed leaves alone are encoded, and the sums on their paths to the root are set right.

Defined results: null text counts as empty and has no tokens; an edit's position and length are held to the text as it then is; rows
that come twice are counted twice; a null doc_id stays null; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.bytebpe import PART_CHARS, encoding, parts
from millrace.llm.common import per_chunk, texts

#: Characters of a leaf, about: a LEAVES-th of its text, but within these bounds; so an edit encodes a small share of any text but the shortest.
LEAVES, LEAST_CHARS, MOST_CHARS = 96, 16, 384


class CountTree:
    """Leaves of text under two trees of sums; tree[1] is the root and leaf k is at width + k."""

    def __init__(self, leaves: list[str], count: Callable[[str], int], tokens: list[int] | None = None):
        self.count = count
        self.leaves = leaves or [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        pad = [0] * (self.width - len(self.leaves))
        self.encoded = 0
        self.chars = [0] * self.width + [len(x) for x in self.leaves] + pad
        self.tokens = [0] * self.width + ([count(x) for x in self.leaves] if tokens is None else list(tokens)) + pad
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and the position in it (of an empty text, or at the end, the last with text)."""
        position = min(position, self.chars[1] - 1)
        if position < 0:
            return 0, 0
        k = 1
        while k < self.width:
            k *= 2
            if position >= self.chars[k]:
                position -= self.chars[k]
                k += 1
        return k - self.width, position

    def put(self, leaf: int, text: str) -> None:
        """Sets a leaf's text; its sums follow with update()."""
        self.leaves[leaf] = text
        self._add(self.chars, leaf, len(text) - self.chars[self.width + leaf])

    def _add(self, tree: list[int], leaf: int, change: int) -> None:
        k = self.width + leaf
        while k and change:
            tree[k] += change
            k //= 2

    def edit(self, position: int, removed: int, inserted: str) -> None:
        position = max(0, min(position, self.chars[1]))
        removed = max(0, min(removed, self.chars[1] - position))
        first, at = self.find(position)
        if position == self.chars[1]:
            at = len(self.leaves[first])
        changed = {first}
        text = self.leaves[first]
        rest = removed - (cut := min(removed, len(text) - at))
        self.put(first, text[:at] + inserted + text[at + cut :])
        last = first
        while rest:
            last += 1
            cut = min(rest, len(self.leaves[last]))
            if cut:
                rest -= cut
                changed.add(last)
                self.put(last, self.leaves[last][cut:])
        # boundary context: where a match may cross a border, the right leaf's text goes to the left leaf
        left = self._beside(first, -1)
        k = first if left is None else left
        while k is not None and k <= last + 1:
            right = self._beside(k, 1)
            if right is None:
                break
            if self.leaves[k] and self._crossed(self.leaves[k][-1], self.leaves[right][0]):
                self.put(k, self.leaves[k] + self.leaves[right])
                self.put(right, "")
                changed |= {k, right}
                last = max(last, right)
            else:
                k = right
        for leaf in changed:
            self.encoded += len(self.leaves[leaf])
            self._add(self.tokens, leaf, self.count(self.leaves[leaf]) - self.tokens[self.width + leaf])

    def _beside(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves):
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    @staticmethod
    def _crossed(before: str, after: str) -> bool:
        return before.isspace() or after not in " \n"


def counter(rank_file: str, pattern: str) -> Callable[[str], int]:
    encode = encoding(rank_file, pattern).encode_ordinary
    return lambda text: sum(len(encode(p)) for p in parts(text)) if len(text) > PART_CHARS else len(encode(text))


def leaf_chars(n: int) -> int:
    return min(MOST_CHARS, max(LEAST_CHARS, n // LEAVES))


def count_trees(docs: DataFrame, rank_file: str, pattern: str, size: Callable[[int], int] = leaf_chars) -> DataFrame:
    """doc_id, text, n_chars, n_tokens, leaf_chars and leaf_tokens (the leaves, in order; the tree's sums follow from them)."""

    def work(batch: pa.RecordBatch) -> dict:
        count = counter(rank_file, pattern)
        leaves = [parts(t, size(len(t))) for t in batch.column("text").to_pylist()]
        tokens = [[count(x) for x in some] for some in leaves]
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_chars": [sum(map(len, x)) for x in leaves], "n_tokens": [sum(x) for x in tokens], "leaf_chars": [[len(x) for x in some] for some in leaves], "leaf_tokens": tokens}

    return per_chunk(texts(docs), work, "doc_id long, text string, n_chars long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(trees: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Applies each row's edits (array of position, removed, inserted; one after the other). Adds edited (the text),
    edited_tokens, encoded_chars (what had to be encoded again)."""

    def work(batch: pa.RecordBatch) -> dict:
        count = counter(rank_file, pattern)
        out: dict[str, list] = {"edited": [], "edited_tokens": [], "encoded_chars": []}
        for text, sizes, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
            leaves, low = [], 0
            for size in sizes:
                leaves.append(text[low : low + size])
                low += size
            tree = CountTree(leaves, count, tokens)
            for e in edits or ():
                tree.edit(e["position"], e["removed"], e["inserted"] or "")
            out["edited"].append("".join(tree.leaves))
            out["edited_tokens"].append(tree.tokens[1])
            out["encoded_chars"].append(tree.encoded)
        return {c: batch.column(c) for c in ("doc_id", "n_chars", "n_tokens")} | out

    columns = ["doc_id", "text", "n_chars", "n_tokens", "leaf_chars", "leaf_tokens", "edits"]
    return per_chunk(trees.select(*columns), work, "doc_id long, n_chars long, n_tokens long, edited string, edited_tokens long, encoded_chars long")
