"""Edit-aware token counts.

A document's pre-tokens are cut into leaves of LEAF; a segment tree over the leaves holds characters and tokens. Pre-tokens are
encoded each alone, so tokens add up, and where a pre-token begins depends on a few characters before it only. An edit finds its
leaves by descending along the characters; the text from a leaf a little before it is split again until a pre-token begins where
an untouched leaf did. Only that region is encoded; its leaves and the sums above them change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import not_made, slices
from .pretokens import Words, words_of

LEAF = 32
#: Characters before an edit that a pre-token's end may depend on, and characters after a leaf's begin that confirm it; more where the
#: name of a special token is longer.
MARGIN = 16


class Tree:
    """Characters and tokens of leaves, and of all nodes above them."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = 1
        while self.leaves < len(chars):
            self.leaves *= 2
        self.n = len(chars)
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, values: list[int]) -> list[int]:
        rows = [np.zeros(self.leaves, np.int64)]
        rows[0][: len(values)] = values
        while len(rows[-1]) > 1:
            rows.append(rows[-1].reshape(-1, 2).sum(1))
        return [0, *(x for r in reversed(rows) for x in r.tolist())]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with character at (the last one with any, beyond all), and where it begins."""
        at = max(0, min(at, self.chars[1] - 1))
        node, begin = 1, 0
        while node < self.leaves:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.leaves, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def values(self) -> tuple[list[int], list[int]]:
        end = self.leaves + self.n
        return self.chars[self.leaves : end], self.tokens[self.leaves : end]


def _leaves(begins: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(begins):
        return [0], [0]
    first = np.arange(0, len(begins), LEAF)
    return np.add.reduceat(ends - begins, first).tolist(), np.add.reduceat(n, first).tolist()


def split(words: Words, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """Begins, ends and token counts of the pre-tokens of each text; None where the library must take the text whole."""
    if not texts:
        return []
    joined, points, begins, ends, text, odd = words.pieces(texts)
    _, n = words.located(joined, points, begins, ends)
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    base = np.cumsum([1, *(0 if x else len(t) for t, x in zip(texts, odd.tolist()))]) + np.arange(len(texts) + 1)
    return [None if odd[i] else (begins[at[i] : at[i + 1]] - base[i], ends[at[i] : at[i + 1]] - base[i], n[at[i] : at[i + 1]]) for i in range(len(texts))]


def count(words: Words, texts: list[str]) -> list[tuple[list[int], list[int]]]:
    """Leaves of each text; a text that the library takes whole is one leaf."""
    out = []
    for text, found in zip(texts, split(words, texts)):
        out.append(([len(text)], [len(words.whole([text])[0])]) if found is None else _leaves(*found))
    return out


class Document:
    def __init__(self, text: str, chars: list[int], tokens: list[int], margin: int = MARGIN):
        self.text, self.tree, self.encoded, self.margin = text, Tree(chars, tokens), 0, margin

    def begin(self, pos: int | None, n_del: int | None, ins: str | None) -> None:
        """An edit's region in the new text, to be encoded; positions and lengths are cut to the text."""
        old = self.text
        pos = max(0, min(pos or 0, len(old)))
        end = max(pos, min(pos + (n_del or 0), len(old)))
        self.first, self.start = self.tree.find(pos - self.margin)
        self.last, self.old_end = self.tree.find(end)
        self.old_end += self.tree.chars[self.tree.leaves + self.last]
        self.shift = len(ins or "") - (end - pos)
        self.text = old[:pos] + (ins or "") + old[end:]
        self.checks: list[tuple[int, int]] = []
        self.more(2)

    def more(self, leaves: int) -> None:
        """Takes in more leaves behind; each one's old begin may be where the new pre-tokens meet the old ones."""
        taken, total = 0, self.tree.chars[1]
        while self.old_end < total and (taken < leaves or self.old_end - self.checks[0][0] < self.margin):
            self.last, at = self.tree.find(self.old_end)
            self.checks.append((at, self.last))
            self.old_end = at + self.tree.chars[self.tree.leaves + self.last]
            taken += 1
        self.region = self.text[self.start : self.old_end + self.shift]

    def settle(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
        """Puts the region's counts in the tree; False if the pre-tokens don't meet the old ones yet."""
        begins, ends, n = found
        whole = self.old_end >= self.tree.chars[1]
        stop, upto = len(self.region), self.last
        for at, leaf in self.checks:
            new = at + self.shift - self.start
            k = int(np.searchsorted(begins, new))
            if len(self.region) - new >= self.margin and k < len(begins) and begins[k] == new:
                stop, upto = new, leaf - 1
                begins, ends, n = begins[:k], ends[:k], n[:k]
                break
        else:
            if not whole:
                return False
        self.encoded += stop
        for leaf in range(self.first + 1, upto + 1):
            self.tree.put(leaf, 0, 0)
        self.tree.put(self.first, int((ends - begins).sum()), int(n.sum()))
        if len(begins) > 8 * LEAF:  # a leaf this long is cut again
            chars, tokens = self.tree.values()
            c, t = _leaves(begins, ends, n)
            self.tree = Tree([*chars[: self.first], *c, *chars[self.first + 1 :]], [*tokens[: self.first], *t, *tokens[self.first + 1 :]])
        return True

    def whole(self, tokens: int) -> None:
        """The library has taken the text whole."""
        self.encoded += len(self.text)
        self.tree = Tree([len(self.text)], [tokens])


def apply(words: Words, docs: list[Document], edits: list[list]) -> None:
    """Applies each document's (pos, n_del, ins) in order; regions of all documents are encoded together, an edit of each at a time."""
    for k in range(max([0, *map(len, edits)])):
        jobs = [d for d, e in zip(docs, edits) if k < len(e)]
        for d, e in zip(docs, edits):
            if k < len(e):
                d.begin(*e[k])
        leaves = 2
        while jobs:
            again = []
            for d, found in zip(jobs, split(words, [d.region for d in jobs])):
                if found is None:
                    d.whole(len(words.whole([d.text])[0]))
                elif not d.settle(found):
                    again.append(d)
            leaves *= 2
            for d in again:
                d.more(leaves)
            jobs = again


_SCHEMA = (("n_tokens", "long"), ("leaf_chars", "array<int>"), ("leaf_tokens", "array<int>"))


def counted(docs: DataFrame, *, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, text, n_tokens and the leaves (leaf_chars, leaf_tokens) of each row of docs(text, ...). A null or empty text has
    no tokens. Repeated rows give repeated rows, ties don't arise; empty in, empty out. Other columns of docs are ignored, whatever
    their names; ValueError if keep names text, n_tokens, leaf_chars or leaf_tokens. A text of any length is one row of a task, two
    integers for each 32 pre-tokens beside it."""
    not_made(keep, ("text", "_text", *(n for n, _ in _SCHEMA)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            for part in slices(batch, "_text"):
                found = count(words, part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("_text"), pa.array([sum(t) for _, t in found], pa.int64()), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.int32()))], [*keep, "text", *(n for n, _ in _SCHEMA)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "text string", *(f"{n} {t}" for n, t in _SCHEMA)])
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


def edited(state: DataFrame, *, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of counted() with a column edits, an array of structs (pos, n_del, ins) applied in order, each to the text that the one
    before it left: the kept columns, the new text, n_tokens and leaves, n_tokens_before, and encoded_chars, the characters encoded anew.

    Positions and lengths beyond the text are cut to it, below 0 they are 0, nulls are 0 and "". Null or no edits change nothing.
    Any text is cut into pre-tokens here; only one with the noncharacter U+10FFFF is encoded whole. A document's edits come in its row, as
    its text does. Repeated rows give repeated rows; empty in, empty out; ValueError if keep names a column that is added here. Trees of
    long texts lie in their row: two integers for each 32 pre-tokens.
    """
    not_made(keep, ("text", *(n for n, _ in _SCHEMA), "n_tokens_before", "encoded_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        for batch in batches:
            for part in slices(batch):
                before = part.column("n_tokens")
                margin = max(MARGIN, words.longest_name + 4)
                docs = [Document(t, c, n, margin) for t, c, n in zip(*(part.column(x).to_pylist() for x in ("text", "leaf_chars", "leaf_tokens")))]
                apply(words, docs, [[(x["pos"], x["n_del"], x["ins"]) for x in e or [] if x] for e in part.column("edits").to_pylist()])
                leaves = [d.tree.values() for d in docs]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([d.text for d in docs], pa.string()), pa.array([d.tree.tokens[1] for d in docs], pa.int64()), pa.array([c for c, _ in leaves], pa.list_(pa.int32())), pa.array([t for _, t in leaves], pa.list_(pa.int32())), before, pa.array([d.encoded for d in docs], pa.int64())], [*keep, "text", *(n for n, _ in _SCHEMA), "n_tokens_before", "encoded_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*keep).schema), "text string", *(f"{n} {t}" for n, t in _SCHEMA), "n_tokens_before long", "encoded_chars long"])
    return state.select(*keep, "text", "n_tokens", "leaf_chars", "leaf_tokens", "edits").mapInArrow(run, schema)
