"""Removal of repeated passages, exact to the byte, with suffix arrays.

A window is a string of WINDOW bytes. Its key is the smallest hash of the GRAM-byte strings in it, so equal windows have equal keys,
and neighbouring windows mostly share one. Windows of a key that only one document has can't repeat elsewhere; a shuffle of keys
finds the others. That shuffle also carries a hash of the run of windows that a slice of documents has under the key, and its
smallest document: of slices with the same run only the one of the smallest document sends it on, the windows of the others go.
So a passage of any number of copies is one text, before any text is shuffled. Runs that have different ones under their key go to
the shard of the key.

A shard's text gets a sparse suffix array, of the suffixes that begin windows: sorted by their first 8 bytes, then groups of more than
one by the next 8, up to WINDOW, until all stand alone. Common prefixes of neighbours, compared side by side, tell which share a
window. A shard with more text than MEMBER is cut into members with arrays of their own, whose classes of windows find each other
by binary search. The smallest document of a class keeps its window, the others' go. Equal windows have one key and so one shard:
arrays of different shards have no window in common, and merging them across shards means merging those members.

A key whose different runs have more text than MEMBER is hot: its windows are dealt one by one, by a hash of the whole window, so that
no shard gets all of them and equal ones still meet.

Keys and runs go between tasks as rows of many: a task gathers those of its slices, up to KEYS keys or DEAL bytes of runs, and makes a
row for each part or shard, with numbers as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _FACTOR, _INVERSE, _LETTER, bucketed, mix64, powers, slices, spill, utf8

WINDOW, GRAM = 50, 16
#: Bytes of text in a member of a shard; shards are cut for about half of it.
MEMBER = 8 << 20
#: Bytes of text in a bucket of slices where there are more than the session's partitions, and how many partitions there are at most.
BUCKET, MOST_PARTS = 32 << 20, 100_000
#: Keys, and bytes of runs or slices of text, that a task gathers before it deals them out: a row for each part or shard.
KEYS, DEAL, DEAL_SLICES = 1 << 20, 4 << 20, 32
_LAST = np.iinfo(np.int64).max


def runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one key in the texts data[offsets[i]:offsets[i + 1]]: key, text, first window and the one
    after the last (as positions from offsets[0])."""
    base = offsets[0]
    part = data[base : offsets[-1]]
    n = len(part) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_LETTER[part] * powers(_FACTOR, len(part)), out=sums[1:])
    low = mix64((sums[gram:] - sums[:-gram]) * powers(_INVERSE, len(part) + 1)[: len(sums) - gram])
    wide, reach = window - gram + 1, 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    last = np.maximum(offsets[1:] - base - window + 1, offsets[:-1] - base)  # a text's windows end here
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, np.minimum(offsets[:-1] - base, n), 1)
    np.add.at(valid, np.minimum(last, n), -1)
    valid = np.cumsum(valid)[:n] > 0
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    starts = offsets[:-1] - base
    change[starts[starts < n]] = True
    first = np.flatnonzero(change)
    end = np.append(first[1:], n)
    keep = valid[first]
    first, end = first[keep], end[keep]
    text = np.searchsorted(offsets[1:] - base, first, "right")
    return low[first].view(np.int64), text, first, end


def suffix_array(text: np.ndarray, at: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Positions in the order of the suffixes that begin there: all of them, or those in at; by their first depth bytes, if it is given."""
    n = len(text)
    words = np.append(_eights(text), np.uint64(0))
    order = np.arange(n) if at is None else at
    order = order[np.argsort(words[order])]
    word = words[order]
    new = np.append(True, word[1:] != word[:-1])[: len(order)]
    for h in range(8, n if depth is None else depth, 8):
        # Places in the array of groups with more than one suffix; the others are where they belong.
        live = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(live):
            break
        suffix, group = order[live], np.cumsum(new[live])
        word = words[np.minimum(suffix + h, n)]
        by = _by_group(group, word)
        order[live], word = suffix[by], word[by]
        new[live[1:]] |= word[1:] != word[:-1]
    if depth is None and not new.all():  # equal but for zeros at the end of the text: the shorter one is first
        order = order[np.lexsort((-order, np.cumsum(new)))]
    return order


def _by_group(group: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order of group, then word."""
    by = np.argsort(word)
    ranks = np.empty(len(word), np.int64)
    ranks[by] = np.cumsum(np.append(False, word[by][1:] != word[by][:-1]))
    return np.argsort(group * (ranks[by[-1]] + 1) + ranks)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number that compares as they do; zeros behind the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)].copy().view(">u8")[:, 0].astype(np.uint64)


_LEAD = np.array([1 << (64 - 8 * k) for k in range(1, 8)], np.uint64)  # below it: k leading bytes are 0


def common_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For each position in first[i]:end[i]: how many bytes it shares with the one before it in order, up to most; 0 elsewhere. All
    are compared side by side, eight bytes a step."""
    n = len(text)
    words, out = _eights(text), np.zeros(n, np.int32)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, end, -1)
    place = np.flatnonzero(np.cumsum(inside)[order[1:]])
    i, j = order[place + 1], order[place]
    room = np.minimum(most, n - np.maximum(i, j))
    shared, live, h = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(live):
        x = words[i[live] + h] ^ words[j[live] + h]
        ended = x != 0
        shared[live[ended]] = h + 7 - np.searchsorted(_LEAD[::-1], x[ended], "right")
        live, h = live[~ended], h + 8
        shared[live] = h
        live = live[h < room[live]]
    out[i] = np.minimum(shared, room)
    return out


def _words(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The windows at these positions as rows of big-endian words, which compare as the bytes do."""
    eights = np.append(_eights(text), np.zeros(8, np.uint64))
    out = np.stack([eights[at + k] for k in range(0, window, 8)], 1)
    if window % 8:
        out[:, -1] &= np.uint64((1 << 64) - (1 << (64 - 8 * (window % 8))))
    return out


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    less, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
    for k in range(a.shape[1]):
        less |= equal & (a[:, k] < b[:, k])
        equal &= a[:, k] == b[:, k]
    return less


def find(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each row is in sorted_rows by binary search, -1 if it isn't."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(sorted_rows))
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        less = _below(sorted_rows[mid], rows[live])
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
    inside = np.minimum(low, max(len(sorted_rows) - 1, 0))
    return np.where((low < len(sorted_rows)) & (sorted_rows[inside] == rows).all(1), low, -1) if len(sorted_rows) else np.full(len(rows), -1)


class Member:
    """Runs of windows: their texts one after another, and the document of each."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int):
        begin = np.cumsum(lengths) - lengths
        hashes = _run_hashes(text, begin, lengths)
        _, self.kind, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.of = self.of.reshape(-1)
        same = lengths == lengths[self.kind][self.of]
        differ = np.flatnonzero(~same | ~_equal(text, begin, begin[self.kind][self.of], np.where(same, lengths, 0)))
        if len(differ):  # a hash for two texts: the runs stand for themselves
            self.of[differ] = len(self.kind) + np.arange(len(differ))
            self.kind = np.append(self.kind, differ)
        self.docs = docs
        self.low = np.full(len(self.kind), _LAST)
        np.minimum.at(self.low, self.of, docs)
        lengths = lengths[self.kind]
        self.end = np.cumsum(lengths)
        self.begin = self.end - lengths
        text = _gathered(text, begin[self.kind], lengths)
        start = np.zeros(len(text) + 1, np.int32)
        start[self.begin] += 1
        start[self.end - window + 1] -= 1
        self.windows = suffix_array(text, np.flatnonzero(np.cumsum(start)[:-1]), window)
        new = common_prefixes(text, self.windows, self.begin, self.end - window + 1, window)[self.windows] < window
        first, self.window_class = np.flatnonzero(new), np.cumsum(new) - 1
        run = np.repeat(np.arange(len(lengths)), lengths)
        self.least = np.minimum.reduceat(self.low[run[self.windows]], first) if len(first) else np.zeros(0, np.int64)
        self._text, self._first, self._window = text, self.windows[first], window

    @cached_property
    def rows(self) -> np.ndarray:
        """A window of each class."""
        return _words(self._text, self._first, self._window)

    def meet(self, other: "Member") -> None:
        """Learns of the other's documents."""
        at = find(other.rows, self.rows)
        hit = np.flatnonzero(at >= 0)
        self.least[hit] = np.minimum(self.least[hit], other.least[at[hit]])

    def gone(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Run and its first and last windows that go, for each stretch of them."""
        least = np.full(int(self.end[-1]) if len(self.end) else 0, _LAST)
        least[self.windows] = self.least[self.window_class]
        lengths = (self.end - self.begin)[self.of]
        first = self.begin[self.of]
        total = np.cumsum(lengths)
        here = np.repeat(first - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)
        goes = least[here] < np.repeat(self.docs, lengths)
        goes[total - 1] = False  # never a window, so stretches end with their run
        edge = np.diff(goes.astype(np.int8), prepend=0)
        b, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.searchsorted(total, b, "right")
        return run, b - (total - lengths)[run], e - (total - lengths)[run]


def _gathered(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches that begin there, one after another; positions are made for about DEAL bytes at once."""
    end = np.cumsum(lengths)
    out = np.empty(int(end[-1]) if len(end) else 0, text.dtype)
    cuts = np.unique(np.append(np.searchsorted(end, np.arange(0, len(out), DEAL)), len(end))).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        first = int(end[lo] - lengths[lo])
        out[first : end[hi - 1]] = text[np.repeat(begin[lo:hi] - (end[lo:hi] - lengths[lo:hi]), lengths[lo:hi]) + np.arange(first, int(end[hi - 1]))]
    return out


def _run_hashes(text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LETTER[text] * powers(_FACTOR, len(text)), out=sums[1:])
    return mix64((sums[begin + lengths] - sums[begin]) * powers(_INVERSE, len(text) + 1)[begin] ^ lengths.astype(np.uint64))


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    differ = np.flatnonzero(text[np.repeat(a, lengths) + step] != text[np.repeat(b, lengths) + step])
    out = np.ones(len(a), bool)
    out[np.searchsorted(at + lengths, differ, "right")] = False
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of documents with bounded text: slice, ids (null ids last of all), null_id, the texts' bytes and where each ends."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            ends = pa.array([(offsets[1:] - offsets[0]).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), ends, pa.array([data[offsets[0] : offsets[-1]].tobytes()], pa.binary())], ["slice", "ids", "ends", "bytes"])
            number += 1


def _opened(batch: pa.RecordBatch, i: int) -> tuple[int, list, np.ndarray, np.ndarray, np.ndarray]:
    """slice, ids, ids for comparison, offsets and bytes of row i."""
    ids = batch.column("ids")[i].as_py()
    offsets = np.append(0, np.array(batch.column("ends")[i].as_py(), np.int64))
    return batch.column("slice")[i].as_py(), ids, np.array([_LAST if x is None else x for x in ids], np.int64), offsets, np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values[edges[i]:edges[i + 1]] as the bytes of row i."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What _binary() has made: the values of all rows and their edges."""
    data, offsets = utf8(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _grouped(by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that has equal numbers together, those numbers once each, and the edges of their groups."""
    order = np.argsort(by.astype(np.uint16) if len(by) and 0 <= by.min() and by.max() < 1 << 16 else by, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(by[order], prepend=~by[order][:1])), len(by))
    return order, by[order][edges[:-1]], edges


#: Columns of the rows of keys; many of them are one row of bytes between tasks.
_KEYED = {"key": np.int64, "only": np.int64, "doc": np.int64, "slice": np.int64, "code": np.int8}


def _keys(window: int, gram: int, parts: int):
    """The keys of some slices, dealt to parts: a row for each part."""

    def of_slice(number, docs, offsets, data) -> tuple[np.ndarray, ...]:
        key, text, begin, end = runs(data, offsets, window, gram)
        order = np.lexsort((docs[text], key))
        key, doc, begin, end = key[order], docs[text][order], begin[order], end[order] + window - 1
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        last = np.append(first[1:], len(key)) - 1
        many = doc[first] != doc[last] if len(key) else np.zeros(0, bool)
        weight, only = _contents(data, begin, end, first)
        return key[first], only, doc[first], np.full(len(first), number, np.int64), (2 * weight + many).astype(np.int8)

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held)]
        order, part, edges = _grouped((mix64(columns[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(part), *(_binary(x[order], edges) for x in columns)], ["part", *_KEYED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                number, _, docs, offsets, data = _opened(batch, i)
                held.append(of_slice(number, docs, offsets, data))
                if sum(len(x[0]) for x in held) >= KEYS:
                    yield dealt(held)
                    held = []
        if held:
            yield dealt(held)

    return run


def _contents(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the runs of each key, which begin at first: the least w with 256 << w not below the bytes of those that differ; and the hash of
    its run where none differ, else 0."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _run_hashes(data, begin, end - begin)
    low, high = np.minimum.reduceat(hashes, first), np.maximum.reduceat(hashes, first)
    size = np.add.reduceat(end - begin, first)
    size[low == high] = (end - begin)[first][low == high]
    large = (size > 256) & (low != high)
    if large.any():
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begin))))
        at = np.flatnonzero(large[of])
        at = at[np.lexsort((hashes[at], of[at]))]
        at = at[np.append(True, (hashes[at][1:] != hashes[at][:-1]) | (of[at][1:] != of[at][:-1]))]
        size[large] = 0
        np.add.at(size, of[at], (end - begin)[at])
    return np.ceil(np.log2(np.maximum(size, 256) / 256)).astype(np.int64), np.where(low == high, low, np.uint64(0)).view(np.int64)


SHIP, LOST, OWN, CUT = 0, 1, 2, 3


def _shared(most: int):
    """Of rows in the order of key, only and doc, those of keys in more than one document, and what the slice does with its windows of the
    key: SHIP them, as other runs have the key; LOST, for a smaller document in another slice has the same run; OWN, there are
    copies of the run in this slice only. For each hot key a row with the bytes of its different runs, negative, as slice. Of a key two
    rows wait at most: the last one for the next, and that of its first run until another run turns up."""
    names = ("key", "only", "doc", "slice", "code")

    def rows(key, number, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(number, pa.int64()), pa.array(kind, pa.int8())], ["key", "slice", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = [np.zeros(0, np.int64) for _ in names]
        before: tuple[int, int, int] | None = None  # key, only and first document of the row passed last
        several = False  # whether its key has had different runs
        first_run: tuple[int, int, int] | None = None  # key, slice and code of the first run of that key, not decided yet
        counted: tuple[int, int] | None = None  # that key, and bytes that are shipped for it
        hot: list[tuple[int, int]] = []
        for batch in _with_end(batches):
            new = [batch.column(c).to_numpy().astype(np.int64) for c in names] if batch is not None else [np.zeros(0, np.int64)] * 5
            key, only, doc, number, code = (np.concatenate([w, n]) for w, n in zip(waiting, new))
            n = len(key) - (batch is not None)
            if n <= 0:
                if len(key):
                    waiting = [key, only, doc, number, code]
                continue
            waiting = [x[n:] for x in (key, only, doc, number, code)]
            goes_on = before is not None and before[0] == key[0]
            equal = key[1:] == key[:-1]
            as_before = np.append(goes_on, equal)[:n]
            same = np.append(goes_on and before[1] == only[0], equal & (only[1:] == only[:-1]))[:n]
            shared = (code[:n] & 1 > 0) | as_before | np.append(equal, False)[:n]
            key, only, doc, number, code = (x[:n] for x in (key, only, doc, number, code))
            lead = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            first = np.where(lead < 0, before[2] if before else 0, doc[lead])
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            differ = np.maximum.reduceat(((~same & as_before) | (only == 0)).astype(int), starts) > 0
            differ[0] |= goes_on and several
            if first_run is not None and (not goes_on or differ[0] or len(starts) > 1):
                if goes_on and differ[0]:
                    yield rows([first_run[0]], [first_run[1]], [SHIP])
                elif first_run[2] & 1:
                    yield rows([first_run[0]], [first_run[1]], [OWN])
                if counted and goes_on and differ[0]:
                    counted = counted[0], counted[1] + (256 << (first_run[2] >> 1))
                first_run = None
            several = bool(differ[-1])
            alone = ~np.repeat(differ, np.diff(np.append(starts, n)))  # the key has one run, as far as is known
            leads = ~same & (only != 0)
            kind = np.where(same & (only != 0) & (doc > first), LOST, np.where(leads & alone, OWN, SHIP))
            keep = shared & ~((kind == OWN) & (code & 1 == 0))
            if leads[starts[-1]] and alone[-1] and not (len(starts) == 1 and goes_on):
                first_run = int(key[starts[-1]]), int(number[starts[-1]]), int(code[starts[-1]])
                keep[starts[-1]] = False
            before = int(key[-1]), int(only[-1]), int(first[-1])
            sums = np.add.reduceat(np.where(kind == SHIP, np.int64(256) << (code >> 1), 0), starts)
            if counted and goes_on:
                sums[0] += counted[1]
            elif counted and counted[1] > most:
                hot.append(counted)
            hot.extend((k, v) for k, v in zip(key[starts[:-1]].tolist(), sums[:-1].tolist()) if v > most)
            counted = int(key[-1]), int(sums[-1])
            yield rows(key[keep], number[keep], kind[keep])
        if first_run is not None and first_run[2] & 1:
            yield rows([first_run[0]], [first_run[1]], [OWN])
        if counted and counted[1] > most:
            hot.append(counted)
        yield rows([k for k, _ in hot], [-v for _, v in hot], [SHIP] * len(hot))

    return run


def _with_end(batches):
    yield from batches
    yield None


def _marked(most: int):
    """A part's keys, put in order and given to _shared(): for each slice its keys and what it does with them, hot ones CUT, how many go
    to shards, and (in one row of the part) the bytes of its hot keys. A part is about BUCKET / 2 bytes of text, some 40 MB of rows;
    a key has a row for each slice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[_numbers(batch.column(c), kind)[0] for c, kind in _KEYED.items()] for batch in batches]
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held)]
        order = np.argsort(columns[0])
        columns = [x[order] for x in columns]
        new = np.append(True, columns[0][1:] != columns[0][:-1])
        alone = new & np.append(new[1:], True)
        columns = [x[~alone | (columns[4] & 1 > 0)] for x in columns]  # the others are of one document
        order = np.lexsort((columns[2], columns[1], columns[0]))
        found = list(_shared(most)(iter([pa.RecordBatch.from_arrays([pa.array(x[order]) for x in columns], list(_KEYED))])))
        key, number, kind = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in found]) for c in ("key", "slice", "kind"))
        hot = number < 0
        weight = -int(number[hot].sum())
        kind = np.where((kind == SHIP) & np.isin(key, key[hot]), CUT, kind).astype(np.int8)
        key, number, kind = key[~hot], number[~hot], kind[~hot]
        if not len(key):
            return
        order, own, edges = _grouped(number)
        ships = np.add.reduceat(np.isin(kind[order], (SHIP, CUT)).astype(np.int64), edges[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(own), _binary(key[order], edges), _binary(kind[order], edges), pa.array(ships), pa.array(np.append(weight, np.zeros(len(ships) - 1, np.int64)))], ["slice", "keys", "kinds", "ships", "weight"])

    return run


#: Rows of runs: of a shard those of some slices, a list of numbers as bytes; without a shard (-1) stretches of a slice that go.
_LISTS = {"lengths": np.int32, "docs": np.int64, "slices": np.int64, "texts": np.int32, "begins": np.int32, "of": np.int32}
_RUNS = "slice long, shard long, run_text binary, " + ", ".join(f"{c} binary" for c in _LISTS)


def _run_rows(slice_: np.ndarray, shard: np.ndarray, text: np.ndarray, text_edges: np.ndarray, **lists: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """lists: values and edges; those not given are empty."""
    none = np.zeros(0, np.int64), np.zeros(len(shard) + 1, np.int64)
    columns = (lists.get(c, none) for c in _LISTS)
    return pa.RecordBatch.from_arrays([pa.array(slice_), pa.array(shard), _binary(text, text_edges), *(_binary(x.astype(kind), edges) for (x, edges), kind in zip(columns, _LISTS.values()))], ["slice", "shard", "run_text", *_LISTS])


def _gone(number: int, texts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    one = np.array([0, len(texts)])
    return _run_rows(np.array([number]), np.array([-1]), np.zeros(0, np.uint8), np.zeros(2, np.int64), lengths=(ends - begins, one), texts=(texts, one), begins=(begins, one))


def _members(window: int, gram: int, shards: int, hot_shards: int):
    """Of some slices: rows of the runs whose keys are shared, by shard; of a slice one text for equal runs, with their smallest document.
    Equal runs of larger documents go whole. Runs of hot keys (CUT) are cut into their windows; these rows have each text once for
    a document and slice, and of tells which one stands at each of slices, texts and begins."""

    def windows(number: int, docs, offsets, data, text, first, end) -> Iterator[pa.RecordBatch]:
        counts = end - first
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        text = np.repeat(text, counts)
        hashes = _run_hashes(data, at, np.full(len(at), window))
        order = np.lexsort((at, docs[text], hashes))
        at, text, hashes = at[order], text[order], hashes[order]
        doc, begin, rows = docs[text], at - offsets[text], _words(data, at, window)
        lead = np.maximum.accumulate(np.where(np.diff(hashes, prepend=~hashes[:1]) != 0, np.arange(len(at)), 0))
        same = (rows == rows[lead]).all(1)
        gone = same & (doc > doc[lead])
        yield _gone(number, *_joined(text[gone], begin[gone], window))
        of = np.where(same, lead, np.arange(len(at)))
        left = np.flatnonzero(~gone)
        shard = shards + (mix64(hashes) % np.uint64(max(hot_shards, 1))).astype(np.int64)
        left = left[np.lexsort((of[left], shard[left]))]
        new = np.append(True, (np.diff(of[left]) != 0) | (np.diff(shard[left]) != 0))[: len(left)]
        kinds = of[left[new]]
        edges = np.append(np.flatnonzero(np.diff(shard[left], prepend=-1)), len(left))
        before = np.append(0, np.cumsum(new))  # kinds that come before a place
        which = before[1:] - 1 - np.repeat(before[edges[:-1]], np.diff(edges))
        own, taken = before[edges], data[at[kinds][:, None] + np.arange(window)].reshape(-1)
        yield _run_rows(np.full(len(edges) - 1, number), shard[left[edges[:-1]]], taken, own * window, lengths=(np.full(len(kinds), window), own), docs=(doc[kinds], own), slices=(np.full(len(left), number), edges), texts=(text[left], edges), begins=(begin[left], edges), of=(which, edges))

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        base = np.cumsum([0, *(len(x[0]) for x in held)])
        shard, number, doc, text, begin, first, lengths = (np.concatenate(x) for x in zip(*(x[1:] for x in held)))
        first = first + np.repeat(base[:-1], [len(x[1]) for x in held])
        order, at, edges = _grouped(shard)
        size = np.append(0, np.cumsum(lengths[order]))
        return _run_rows(np.zeros(len(at), np.int64), at, _gathered(np.concatenate([x[0] for x in held]), first[order], lengths[order]), size[edges], **{c: (x[order], edges) for c, x in (("lengths", lengths), ("docs", doc), ("slices", number), ("texts", text), ("begins", begin))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column("wanted")
            (keys, at), (kinds, _) = (_numbers(lists.flatten().field(k), kind) for k, kind in enumerate((np.int64, np.int8)))
            at = at[_edges(lists)]
            for i in range(batch.num_rows):
                number, _, docs, offsets, data = _opened(batch, i)
                key, text, first, end = runs(data, offsets, window, gram)
                end = end + window - 1
                kind = _looked_up(key, keys[at[i] : at[i + 1]], kinds[at[i] : at[i + 1]])
                lost = kind == LOST
                own = np.flatnonzero(kind == OWN)
                own = own[np.lexsort((docs[text[own]], key[own]))]
                head = np.maximum.accumulate(np.where(np.append(True, key[own][1:] != key[own][:-1])[: len(own)], np.arange(len(own)), 0))
                lost[own[docs[text[own]] > docs[text[own]][head]]] = True
                yield _gone(number, *_merged(text[lost], first[lost] - offsets[text[lost]], end[lost] - offsets[text[lost]]))
                if (cut := kind == CUT).any():
                    yield from windows(number, docs, offsets, data, text[cut], first[cut], end[cut] - window + 1)
                keep = kind == SHIP
                key, text, first, end = key[keep], text[keep], first[keep], end[keep]
                if not len(key):
                    continue
                doc, hashes = docs[text], _run_hashes(data, first, end - first)
                order = np.lexsort((first, doc, hashes))
                hashes = hashes[order]
                lead = np.maximum.accumulate(np.where(np.diff(hashes, prepend=~hashes[:1]) != 0, np.arange(len(order)), 0))
                a, b = order, order[lead]
                same = (a != b) & (doc[a] > doc[b]) & (end[a] - first[a] == end[b] - first[b])
                a, b = a[same], b[same]
                gone = np.zeros(len(key), bool)
                gone[a[_equal(data, first[a], first[b], end[a] - first[a])]] = True
                begin = first - offsets[text]
                yield _gone(number, text[gone], begin[gone], begin[gone] + end[gone] - first[gone])
                rest = ~gone
                shard = (mix64(key[rest].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                held.append((data, shard, np.full(len(shard), number), doc[rest], text[rest], begin[rest], first[rest], end[rest] - first[rest]))
                size += int(held[-1][-1].sum())
                if size >= DEAL or len(held) >= DEAL_SLICES:
                    yield dealt(held)
                    held, size = [], 0
        if held:
            yield dealt(held)

    return run


def _looked_up(key: np.ndarray, keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of each key, -1 if it isn't among keys."""
    if not len(keys):
        return np.full(len(key), -1, np.int8)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, key, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == key, kinds[at], -1)


def _joined(texts: np.ndarray, begins: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """texts, begins and ends of the stretches that windows at these places cover."""
    by = np.lexsort((begins, texts))
    texts, begins = texts[by], begins[by]
    first = np.flatnonzero((np.diff(texts, prepend=-1) != 0) | (np.diff(begins, prepend=-2) != 1))
    ends = begins[np.append(first[1:], len(begins))[: len(first)] - 1] + window
    return texts[first], begins[first], ends


def _merged(texts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of texts, those that touch or overlap as one."""
    order = np.lexsort((ends, begins, texts))
    texts, begins, ends = texts[order], begins[order], ends[order]
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(texts * far + ends)
    first = np.flatnonzero(np.append(True, texts[1:] * far + begins[1:] > reach[:-1])) if len(texts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(texts))[: len(first)] - 1
    return texts[first], begins[first], reach[last] - texts[first] * far


def _searched(window: int, most: int):
    """Rows in the order of their shards: slice, and texts, begins and ends of the stretches of bytes to remove."""

    def shard(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        text, text_edges = _numbers(rows.column("run_text"), np.uint8)
        lists = {c: _numbers(rows.column(c), kind) for c, kind in _LISTS.items()}
        # Parts of a shard with most bytes of text, if one row hasn't more.
        cuts, begin = [0], 0
        for i in range(1, rows.num_rows):
            if text_edges[i + 1] - text_edges[begin] > most:
                cuts.append(i)
                begin = i
        cuts.append(rows.num_rows)
        members = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            lengths, docs = (x[e[lo] : e[hi]].astype(np.int64) for x, e in (lists["lengths"], lists["docs"]))
            members.append(Member(text[text_edges[lo] : text_edges[hi]], lengths, docs, window))
        for a in members:
            for b in members:
                if a is not b:
                    a.meet(b)
        for lo, hi, member in zip(cuts[:-1], cuts[1:], members):
            run, begin, end = member.gone()
            if not len(run):
                continue
            run_edges, edges, of_edges = (lists[c][1][lo : hi + 1] for c in ("lengths", "texts", "of"))
            number, texts, begins = (lists[c][0][edges[0] : edges[-1]].astype(np.int64) for c in ("slices", "texts", "begins"))
            if of_edges[0] == of_edges[-1]:  # every run stands where its row says
                yield _stretches(number[run], texts[run], begins[run] + begin, begins[run] + end + window - 1)
                continue
            # Rows with of have windows, each at one or several places; a run of the others is one place.
            cut = np.repeat(np.diff(of_edges) > 0, np.diff(edges))
            of = np.repeat(run_edges[:-1] - run_edges[0] - (edges[:-1] - edges[0]) * (np.diff(of_edges) == 0), np.diff(edges)) + np.where(cut, 0, np.arange(len(cut)))
            of[cut] += lists["of"][0][of_edges[0] : of_edges[-1]]
            goes = cut & np.isin(of, run)
            order, own, bounds = _grouped(number[goes])
            for k, n in enumerate(own.tolist()):
                at = np.flatnonzero(goes)[order[bounds[k] : bounds[k + 1]]]
                t, b, e = _joined(texts[at], begins[at], window)
                yield _stretches(np.full(len(t), n), t, b, e)
            place = np.full(int(run_edges[-1] - run_edges[0]), -1)
            place[of[~cut]] = np.flatnonzero(~cut)
            whole = place[run] >= 0
            at = place[run[whole]]
            yield _stretches(number[at], texts[at], begins[at] + begin[whole], begins[at] + end[whole] + window - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = -1
        for batch in batches:
            number = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = batch.slice(lo, hi - lo)
                if number[lo] < 0:
                    (texts, at), (begins, _), (lengths, _) = (_numbers(part.column(c), np.int32) for c in ("texts", "begins", "lengths"))
                    if len(texts):
                        yield _stretches(np.repeat(part.column("slice").to_numpy(), np.diff(at)), texts, begins, begins + lengths)
                    continue
                if held and last != number[lo]:
                    yield from shard(held)
                    held = []
                held.append(part)
                last = number[lo]
        if held:
            yield from shard(held)

    return run


_PLACES = ("texts", "begins", "ends")


def _stretches(number: np.ndarray, *places: np.ndarray) -> pa.RecordBatch:
    """A row for each slice."""
    order, own, edges = _grouped(number)
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(_binary(x[order].astype(np.int32), edges) for x in places)], ["slice", *_PLACES])


def _edges(lists: pa.Array) -> np.ndarray:
    """Where the lists begin and end in lists.flatten(); null ones are empty."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("found")
        places = [_numbers(found.flatten().field(k), np.int32) for k in range(len(_PLACES))]
        at = places[0][1][_edges(found)]
        for i in range(batch.num_rows):
            _, ids, _, offsets, data = _opened(batch, i)
            texts, begins, ends = (x[at[i] : at[i + 1]] for x, _ in places)
            cover = np.bincount(offsets[texts] + begins, minlength=len(data) + 1) - np.bincount(offsets[texts] + ends, minlength=len(data) + 1)
            gone = np.cumsum(cover)[:-1] > 0
            filled = offsets[1:] > offsets[:-1]
            edge = np.zeros(len(data) + 1, bool)  # spans end with their text
            edge[offsets] = True
            begin = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone)[:-1]))
            end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone, False)[1:])) + 1
            of = np.flatnonzero(filled)[np.searchsorted(offsets[1:][filled], begin, "right")]
            spans = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(of) + 1, 2, dtype=np.int32)), pa.array(np.stack([begin - offsets[of], end - offsets[of]], 1).reshape(-1)))
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(ids) + 1)).astype(np.int32)), spans)
            removed = np.append(0, np.cumsum(gone))[offsets]
            left, kept = memoryview(data[~gone].tobytes()), (offsets - removed).tolist()
            hashes = [hashlib.sha256(left[b:e]).hexdigest() for b, e in zip(kept[:-1], kept[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), spans, pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def _dealt(docs: DataFrame, window: int, gram: int, member: int) -> tuple[DataFrame, DataFrame]:
    """Slices of the documents, and their runs by shard."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = lambda each: min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each)))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed, "slice long, ids array<long>, ends array<long>, bytes binary")
    packed = bucketed(packed, "slice", parts(BUCKET))
    n = parts(BUCKET // 2)
    keyed = packed.mapInArrow(_keys(window, gram, n), "part long, " + ", ".join(f"{c} binary" for c in _KEYED))
    marked = spill(keyed.repartitionById(n, F.col("part").cast("int")).mapInArrow(_marked(member), "slice long, keys binary, kinds binary, ships long, weight long"), compression="zstd")
    ships, weight = (x or 0 for x in marked.agg(F.sum("ships"), F.sum("weight")).first())
    text = ships * 4 * window // 3  # about: a run has some 65 bytes for a window of 50
    shards = max(parts(BUCKET), -(-text * 2 // member))
    hot_shards = -(-weight * window // 3 * 2 // member)  # a run of 65 bytes has some 16 windows
    wanted = marked.groupBy("slice").agg(F.collect_list(F.struct("keys", "kinds")).alias("wanted")).withColumnRenamed("slice", "_slice")
    members = packed.join(wanted, F.col("slice") == F.col("_slice")).mapInArrow(_members(window, gram, shards, hot_shards), _RUNS)
    n = min(MOST_PARTS, shards + hot_shards)
    return packed, members.repartitionById(n, F.expr(f"CAST(IF(shard < 0, slice, shard) % {n} AS INT)")).sortWithinPartitions("shard")


def repeated_passages(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, member: int = MEMBER) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin and end of each maximal stretch of removed bytes), kept_sha256 (of the rest, lowercase
    hex) for each row of docs(doc_id, text), texts as UTF-8.

    A byte goes if it lies in a string of window bytes that also starts in a row with a smaller doc_id; rows of equal ids don't
    count for each other, and a null id is larger than all. Null texts are empty; texts shorter than window stay whole. Other
    columns are ignored; empty in, empty out. Long documents are slices of their own, as they are rows of their own. Runs of one key
    count as equal where their 64-bit hashes are; all other comparisons are of bytes.
    """
    packed, dealt = _dealt(docs, window, gram, member)
    found = spill(dealt.mapInArrow(_searched(window, member), "slice long, " + ", ".join(f"{c} binary" for c in _PLACES)))
    stretches = found.groupBy("slice").agg(F.collect_list(F.struct(*_PLACES)).alias("found")).withColumnRenamed("slice", "_slice")
    return packed.join(stretches, F.col("slice") == F.col("_slice"), "left").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")
